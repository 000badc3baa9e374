"""Incremental scoring: only conversations with new rows, or whose last score failed, are computed, each from all its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmetry.streaming.live import mark_end

#: Arrived rows lie in so many buckets by their key.
BUCKETS = 256
#: So many batches of arrived rows are merged into one, so many of those into one again, and so on.
MERGE = 8
_BUCKET = "_bucket"


def run_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process what is there now, append to ``path``, and stop."""
    query = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, marker: str, one_batch: bool = False) -> None:
    """Process a finished input: all there is, then the end marker, which closes what is open.

    ``stream`` reads its input through ``live.with_end_marker(..., marker)``. Where the source has no rate limit, all there
    is comes in one batch and the marker may come with it (``one_batch``): the watermark moves behind that batch, so no row
    is late, and the query starts once.
    """
    if not one_batch:
        run_available(stream, path, checkpoint)
    mark_end(stream.sparkSession, marker)
    run_available(stream, path, checkpoint)


class Arrivals:
    """All rows that ever arrived, in a layout in which a batch reads only the buckets its keys fall into.

    Batch n is the folder ``g=0/n=<n>``, parted by the bucket of the key. Before batch n, the last ``merge`` folders of a
    generation become one of the next whenever n is a multiple of its length, so a row is rewritten
    log(batches) times, all rows lie in at most ``merge`` folders a generation, and a folder's name tells what
    it holds. A folder counts once its writer has committed; writing it again, as a replayed batch does, changes
    nothing. A bucket with a hot key is split over files by size.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS, merge: int = MERGE):
        if buckets < 1 or merge < 2:
            raise ValueError("there is at least one bucket, and a merge takes at least two folders")
        self.spark, self.path, self.keys, self.buckets, self.merge = spark, path, list(keys), buckets, merge

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def folder(self, generation: int, n: int) -> str:
        return f"{self.path}/g={generation}/n={n}"

    def add(self, batch: DataFrame, batch_id: int) -> None:
        self.compact(batch_id)
        self._write(batch.withColumn(_BUCKET, self.bucket()), self.folder(0, batch_id))

    def _write(self, rows: DataFrame, folder: str) -> None:
        # Rows of a bucket meet in one task, or in several where it is large.
        rows.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)

    def compact(self, batch_id: int) -> None:
        """Merge what batches before ``batch_id`` have filled; a merge that is there already is left alone."""
        generation, length = 1, self.merge
        while batch_id and batch_id % length == 0:
            n = batch_id // length - 1
            target = self.folder(generation, n)
            parts = [self.folder(generation - 1, n * self.merge + i) for i in range(self.merge)]
            if not self._done(target):
                found = [p for p in parts if self._done(p)]
                if found:
                    self._write(self._read(found), target)
            if self._done(target):
                for p in parts:
                    remove(self.spark, p)
            generation, length = generation + 1, length * self.merge

    def folders(self, batch_id: int) -> list[str]:
        """The folders that hold batches 0 to ``batch_id``, each once, the longest first."""
        end, longest = batch_id + 1, 0
        while self.merge ** (longest + 1) <= end:
            longest += 1
        out, at = [], 0
        while at < end:
            for generation in range(longest, -1, -1):
                length = self.merge**generation
                if at % length == 0 and at + length <= end and self._done(self.folder(generation, at // length)):
                    out.append(self.folder(generation, at // length))
                    at += length
                    break
            else:
                at += 1  # a batch without rows
        return out

    def of_keys(self, touched: DataFrame, batch_id: int) -> DataFrame:
        """All rows up to ``batch_id`` of the keys in ``touched`` (distinct); null keys are keys like others."""
        wanted = [r[0] for r in touched.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
        rows = self._read(self.folders(batch_id)).where(F.col(_BUCKET).isin(wanted)).drop(_BUCKET)
        asked = touched.select(*[F.col(k).alias(f"_asked_{k}") for k in self.keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in self.keys])
        return rows.join(asked, same, "left_semi")

    def _read(self, folders: list[str]) -> DataFrame:
        frames = [self.spark.read.parquet(f) for f in folders]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _done(self, folder: str) -> bool:
        return exists(self.spark, f"{folder}/_SUCCESS")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def numbered(spark: SparkSession, path: str, name: str) -> Iterator[int]:
    """The numbers n of the folders ``<name>=n`` below ``path``, rising."""
    fs, at = _fs(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return iter(sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}=")))


class Scores:
    """Results by batch and attempt, and beside them the keys whose last result failed."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], failed: Column | None):
        self.spark, self.path, self.keys, self.failed = spark, path, list(keys), failed

    def write(self, results: DataFrame, batch_id: int, attempt: int = 0) -> None:
        folder = f"{self.path}/batch={batch_id}/attempt={attempt}"
        results.write.mode("overwrite").parquet(folder)
        if self.failed is not None:
            stored = self.spark.read.schema(results.schema).parquet(folder)
            due = stored.where(F.coalesce(self.failed, F.lit(False))).select(*self.keys).distinct()
            due.write.mode("overwrite").parquet(f"{self.path}-due/batch={batch_id}/attempt={attempt}")

    def last(self, before: int | None = None) -> tuple[int, int] | None:
        """Batch and attempt of the last results (of a batch before the one given)."""
        for batch in reversed([b for b in numbered(self.spark, self.path, "batch") if before is None or b < before]):
            done = [a for a in numbered(self.spark, f"{self.path}/batch={batch}", "attempt") if self._whole(batch, a)]
            if done:
                return batch, done[-1]
        return None

    def _whole(self, batch: int, attempt: int) -> bool:
        """Results and, where they are kept, due keys are both written."""
        tables = [self.path] if self.failed is None else [self.path, f"{self.path}-due"]
        return all(exists(self.spark, f"{t}/batch={batch}/attempt={attempt}/_SUCCESS") for t in tables)

    def due(self, before: int | None = None) -> DataFrame | None:
        """The keys to score again. Each batch takes up those of the one before, so the last list holds all."""
        last = self.last(before) if self.failed is not None else None
        return self.spark.read.parquet(f"{self.path}-due/batch={last[0]}/attempt={last[1]}") if last else None


def score_stream(
    convs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("run", "conv_index"),
    failed: Column | None = None,
    buckets: int = BUCKETS,
    merge: int = MERGE,
) -> None:
    """Score the keys of each arriving batch from all their rows so far, tagged with the batch id.

    Arrived rows are kept beside the results (``Arrivals``), so a key whose rows come in several batches is scored
    again as a whole, from the buckets of the keys at hand; ``latest_results`` takes its last score. Where ``failed`` tells failed
    results, their keys are scored again in the next batch, or by ``retry_failed``. A batch that is replayed after a failure
    writes its own folders again instead of adding rows twice, so the tables hold every batch exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        arrivals = Arrivals(spark, f"{path}-rows", keys, buckets, merge)
        scores = Scores(spark, path, keys, failed)
        arrivals.add(batch, batch_id)
        touched = spark.read.parquet(arrivals.folder(0, batch_id)).select(*keys)
        due = scores.due(before=batch_id)
        touched = (touched if due is None else touched.unionByName(due)).distinct()
        scores.write(score(arrivals.of_keys(touched, batch_id)), batch_id)

    convs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def retry_failed(
    spark: SparkSession,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    keys: Sequence[str],
    failed: Column,
    buckets: int = BUCKETS,
    merge: int = MERGE,
) -> bool:
    """Score the failed keys again without waiting for new rows. False where none is due.

    ``buckets`` and ``merge`` as given to ``score_stream``, which must not run at the same time.
    """
    scores = Scores(spark, path, keys, failed)
    last, due = scores.last(), scores.due()
    if due is None or due.isEmpty():
        return False
    batch, attempt = last
    arrivals = Arrivals(spark, f"{path}-rows", keys, buckets, merge)
    scores.write(score(arrivals.of_keys(due, batch)), batch, attempt + 1)
    return True


def latest_results(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last result of each key over all batches and attempts."""
    results = spark.read.parquet(path)
    rest = [c for c in results.columns if c not in (*keys, "batch", "attempt")]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "attempt")).alias("_r"))
    return best.select(*keys, "_r.*")
