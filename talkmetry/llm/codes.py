"""Vector code compression: product codes learned with exact integer arithmetic.

Components become ``floor(4096 * x)`` and vectors are cut into 8 equal consecutive parts. Each part position has a
codebook of up to 16 entries, which starts as that part of the 16 smallest vec_ids. A round gives every part its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each used entry by the
componentwise ``floor(sum / count)`` of its parts; after 6 rounds parts are assigned once more.

* *Limb-split products.* A distance is ``|x|² - 2 x·c + |c|²``. For ``x·c`` both matrices are broken into limbs of so many bits
  that a float64 BLAS product of two limbs stays below 2**53 and is therefore exact; the products are shifted and recombined
  in 64-bit integers (modulo 2**64, which is exact as the distance itself is smaller), then the first minimum is taken.
  Components so large that a distance could pass 63 bits recombine in unbounded integers instead.
* *Rounds.* A round reads the vectors once. Each task adds its parts up per (part, entry, position), Spark adds the tasks'
  sums, and only the codebooks, 16 numbers per component, pass the driver. No vector is shuffled.

Rows whose vector is null or holds null or non-finite components take no part. Repeated ids are separate rows; among the
seeds an id counts once, by its smallest vector, and the null id comes last. Vectors of different lengths have
codebooks of their own. A length that 8 does not divide is padded with zeros at the end, and an empty vector has the code
of eight zeros. An error above 63 bits is null, and so is a label's sum of errors. An empty table gives an empty result. Other columns
of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums of errors are broadcast: below 2 MB.
FEW_LABELS = 50_000
SALTS = 32
#: Bits up to which a float64 holds every integer.
EXACT_BITS = 53
LARGEST = 2**63 - 1

Books = dict[int, np.ndarray]


def kept_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull()).where(finite)


def to_integers(flat: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``: 64-bit integers, or Python's own where 62 bits do not hold them."""
    scaled = np.floor(flat * SCALE) if not len(flat) or np.abs(flat).max() < 2.0**1000 else np.full(len(flat), np.inf)
    if not len(flat) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([math.floor(Fraction(x) * SCALE) for x in flat.tolist()], dtype=object)


def parts_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the rows of that length and their integers as (row, part, position)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = to_integers(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths)
    out = {}
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0), dtype=np.int64)
        if dim % PARTS:
            x = np.concatenate([x, np.zeros((len(rows), -dim % PARTS), dtype=x.dtype)], axis=1)
        out[dim] = rows, x.reshape(len(rows), PARTS, x.shape[1] // PARTS)
    return out


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices of at most ``bits`` bits each, lowest first: ``x == sum(limb << (bits * i))``. The last is signed."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dot(x: np.ndarray, y: np.ndarray, wide: bool = False) -> np.ndarray:
    """Exact products of all rows of ``x`` with all rows of ``y``; modulo 2**64 unless ``wide``."""
    bits = (EXACT_BITS - max(1, x.shape[1]).bit_length()) // 2
    total = np.zeros((len(x), len(y)), dtype=object if wide else np.uint64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            product = (a @ b.T).astype(np.int64)
            if wide:
                total = total + (product.astype(object) << (bits * (i + j)))
            elif bits * (i + j) < 64:
                total += product.view(np.uint64) << np.uint64(bits * (i + j))
    return total if wide else total.view(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row; ties go to the lower index."""
    largest = max((max(abs(int(m.max())), abs(int(m.min()))) for m in (x, book) if m.size), default=0)
    wide = x.shape[1] * (2 * largest) ** 2 > LARGEST
    if wide:
        x, book = x.astype(object), book.astype(object)
    far = (x * x).sum(axis=1)[:, None] - 2 * dot(x, book, wide) + (book * book).sum(axis=1)
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(x)), entry]


def first_books(rows: DataFrame) -> Books:
    """Per vector length the parts of the smallest ids: at most 16 vectors of each length reach the driver."""
    ids = rows.select(F.size("embedding").alias("dim"), "vec_id").distinct()
    lengths = [r["dim"] for r in ids.select("dim").distinct().collect()]
    books = {}
    for dim in lengths:
        seeds = ids.where(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).select(F.col("vec_id").alias("seed"))
        mine = rows.where(F.size("embedding") == dim).join(F.broadcast(seeds), F.col("vec_id").eqNullSafe(F.col("seed")))
        vectors = mine.groupBy("seed").agg(F.min("embedding").alias("embedding")).orderBy(F.asc_nulls_last("seed")).select("embedding").toArrow()
        books[dim] = parts_of(vectors.column(0).combine_chunks())[dim][1].transpose(1, 0, 2)
    return books


def _added(rows: DataFrame, books: Books) -> DataFrame:
    """Sum and count of the parts per (dim, part, entry, position), each task's added up before it leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: np.zeros(book.shape, dtype=object) for dim, book in books.items()}
        counts = {dim: np.zeros(book.shape[:2], dtype=np.int64) for dim, book in books.items()}
        for batch in batches:
            for dim, (_, x) in parts_of(batch.column(0)).items():
                narrow = x.dtype == np.int64 and (not x.size or max(abs(int(x.max())), abs(int(x.min()))) * len(x) <= LARGEST)
                for part in range(PARTS):
                    entry, _ = nearest(x[:, part], books[dim][part])
                    counts[dim][part] += np.bincount(entry, minlength=books[dim].shape[1])
                    added = np.zeros(books[dim].shape[1:], dtype=np.int64 if narrow else object)
                    np.add.at(added, entry, x[:, part] if narrow else x[:, part].astype(object))
                    sums[dim][part] += added.astype(object)
        for dim, total in sums.items():
            part, entry, pos = (a.ravel() for a in np.indices(total.shape))
            n = counts[dim][part, entry]
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(used), dim), type=pa.int32()), "part": pa.array(part[used], type=pa.int32()), "entry": pa.array(entry[used], type=pa.int32()),
                "pos": pa.array(pos[used], type=pa.int32()), "n": pa.array(n[used]), "total": pa.array([str(t) for t in total.ravel()[used]], type=pa.string())})

    sent = rows.select("embedding").mapInArrow(run, "dim int, part int, entry int, pos int, n long, total string")
    exact = F.col("total").cast("decimal(38,0)")
    return sent.groupBy("dim", "part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(exact).cast("string").alias("total"))


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """The codebooks after all rounds: {vector length: (part, entry, position)}."""
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        new = {dim: book.astype(object) for dim, book in books.items()}
        for r in _added(rows, books).toLocalIterator():  # 16 rows per component of each length
            new[r["dim"]][r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        books = {dim: b.astype(np.int64) if all(abs(v) < 2**62 for v in b.ravel()) else b for dim, b in new.items()}
    return books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()


def assign(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error and dim of every row under given codebooks."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, dims = ([None] * batch.num_rows for _ in range(3))
            for dim, (at, x) in parts_of(batch.column("embedding")).items():
                found = [nearest(x[:, part], books[dim][part]) for part in range(PARTS)]
                error = np.sum([far.astype(object) for _, far in found], axis=0)
                for i, row in enumerate(at.tolist()):
                    codes[row] = "".join(f"{entry[i]:02x}" for entry, _ in found)
                    errors[row] = int(error[i]) if error[i] <= LARGEST else None
                    dims[row] = dim
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, type=pa.string()), pa.array(errors, type=pa.int64()), pa.array(dims, type=pa.int32())],
                names=["vec_id", "label", "code", "error", "dim"])

    vec_id = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {vec_id}, label {label}, code string, error long, dim int")


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    rows = kept_rows(vectors)
    books = learn(rows)
    coded = store(assign(rows, books), "codes")
    unknown = F.count_if(F.col("error").isNull()) > 0
    sums = store(coded.groupBy("label").agg(F.when(~unknown, F.try_sum("error")).alias("label_error")), "label-errors")
    if sums.count() <= FEW_LABELS:
        found = coded.join(F.broadcast(sums.withColumnRenamed("label", "_of")), F.col("label").eqNullSafe(F.col("_of")))
    else:  # a label may hold a third of all rows: its rows are dealt to SALTS places, its one sum to each of them
        salted = sums.select(F.col("label").alias("_of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        dealt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        found = coded.withColumn("_to", dealt).join(salted, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_to") == F.col("_salt")))
    names = [x for dim, book in books.items() for x in (F.lit(dim), F.lit(digest(book)))]
    sha = F.create_map(*names)[F.col("dim")] if names else F.lit(None).cast("string")
    return found.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def oracle(table: str = "embeddings") -> str:
    """DuckDB SQL for ``code_report`` on vectors of one length that 8 divides, round by round."""
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})"""
    best = """SELECT r, p, arg_min(struct_pack(e := e, d := d), (d, e)) AS at FROM (
    SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN b{0} USING (p)) u GROUP BY r, p"""
    steps = ""
    for i in range(ROUNDS):
        steps += f"""
, a{i} AS MATERIALIZED ({best.format(i)})
, m{i} AS (SELECT p, a.at.e AS e, j, floor_div(sum(x[j + 1])::HUGEINT, count(*)) AS m FROM a{i} a JOIN parts USING (r, p), range(len(x)) t(j) GROUP BY ALL)
, b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS c FROM m{i} GROUP BY p, e) n USING (p, e))"""
    steps = steps.replace("floor_div(sum(x[j + 1])::HUGEINT, count(*))", "CAST((sum(x[j + 1])::HUGEINT - ((sum(x[j + 1])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)")
    return head + steps + f"""
, last AS MATERIALIZED ({best.format(ROUNDS)})
, coded AS (SELECT r, string_agg(printf('%02x', l.at.e), '' ORDER BY p) AS code, CAST(sum(l.at.d) AS BIGINT) AS error FROM last l GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
