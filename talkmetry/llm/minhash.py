"""MinHash near-dedup: circulant signatures, banding, exact confirmation, connected components.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a document's set is its distinct
``WIDTH``-word shingles (all its words as one shingle if fewer). Two documents are linked where
``100 * intersection >= 85 * union``, always confirmed on the full sets.

* *Signatures.* Two fixed permutations of the 32-bit numbers: the first spreads the shingles, the second is
  shifted circularly once per coordinate, so coordinate k is ``min over x of second((first(x) + k) mod 2**32)``.
* *Equal sets are one class* and enter the search once, as their smallest id; a thousand copies make no pairs.
* *Banding.* ``BANDS`` bands of ``ROWS`` coordinates; a pair at similarity 0.85 meets with probability 1 - 5e-7.
* *Stars first.* Every member of a bucket is confirmed against the bucket's smallest id only; most groups are one
  component then. Buckets that still hold several components are cut into blocks of at most ``BLOCK`` members; blocks
  meet block by block in separate tasks, where signatures pick the pairs whose estimate is within five standard errors
  of the threshold and whose components differ, and the full sets decide. Only links leave the task. No bucket is
  skipped or cut short.

Null and empty texts, and texts without words, have the empty set and are linked with nothing. Rows that repeat an id
are one document. A null id takes part but never names a component unless nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import WordHashes, arrow_map, components, discard, shingle_set, store, texts, under_plain_names, words

WIDTH = 5
PERCENT = 85
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
BLOCK = 512
#: Least share of equal coordinates of a pair worth confirming: 0.85 less five standard errors, sqrt(.85 * .15 / 125).
LEAST_AGREEMENT = 0.69
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection on 32-bit numbers, in place: odd multiplications and xor-shifts can all be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """``COORDINATES`` minima of one permutation shifted circularly, over shingles spread by another."""
    spread = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(spread), 512):
        table = _permute(spread[None, at : at + 512] + _SHIFTS, 0x21F0AAAD, 0xD35A2D97)
        np.minimum(least, table.min(axis=1), out=least)
    return least


def shingles_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return shingle_set(hashes(words(text.lower() if text else text)), WIDTH)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, and the signature's bytes."""

    def rows(batch: pa.RecordBatch) -> dict:
        hashes = WordHashes()
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_shingles": [], "set_a": [], "set_b": [], "signature": []}
        for text in texts(batch.column("text")):
            got = shingles_of(text, hashes)
            digest = xxhash.xxh3_128_digest(got.tobytes())
            out["n_shingles"].append(len(got))
            out["set_a"].append(int.from_bytes(digest[:8], "little", signed=True))
            out["set_b"].append(int.from_bytes(digest[8:], "little", signed=True))
            out["signature"].append(signature(got).tobytes() if len(got) else None)
        return out

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _bands(classes: DataFrame) -> DataFrame:
    """One row per class and band: id, and the hash of the band's number and coordinates."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + i * width, width)) for i in range(BANDS)])
    return classes.select("doc_id", F.explode(keys).alias("bucket"))


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough coordinates, with both sets' sizes close enough for a link."""
    sig = classes.select("doc_id", "n_shingles", "signature")
    both = pairs.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def rows(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        keep = pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)
        return {c: batch.column(c).filter(keep) for c in ("a", "b")}

    return arrow_map(both.select("a", "b", "sig_a", "sig_b"), rows, "a long, b long")


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    if 100 * min(len(left), len(right)) < PERCENT * max(len(left), len(right)):
        return False
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= PERCENT * (len(left) + len(right) - shared)


def _bodies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents named, once each; the same sort-merge plan at every size."""
    return store(docs.select("doc_id", "text").join(ids.distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bodies")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Texts travel, compressed, not the sets."""
    body = _bodies(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.join(body.toDF("a", "text_a").hint("merge"), "a").join(body.toDF("b", "text_b").hint("merge"), "b")

    def rows(batch: pa.RecordBatch) -> dict:
        hashes, known, keep = WordHashes(), {}, []
        for b, x, y in zip(batch.column("b").to_pylist(), texts(batch.column("text_a")), texts(batch.column("text_b"))):
            if b not in known:  # pairs arrive by their right end
                known = {b: shingles_of(y, hashes)}
            keep.append(similar(shingles_of(x, hashes), known[b]))
        mask = pa.array(keep, type=pa.bool_())
        return {c: batch.column(c).filter(mask) for c in ("a", "b")}

    out = store(arrow_map(both.select("a", "b", "text_a", "text_b"), rows, "a long, b long"), "links")
    discard(body)
    return out


def _rest(buckets: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components of one bucket, found and confirmed block against block.

    Signatures choose the pairs of two blocks, best first; a pair that earlier links of the same task have connected needs
    no confirmation. Pairs stay inside the task: only links leave it.
    """
    named = buckets.join(parts, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    open_ = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = named.join(open_.select("bucket", blocks.alias("blocks")), "bucket")
    # Buckets with the same members ask the same question: one of them is enough.
    same = members.groupBy("bucket").agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"), F.count(F.lit(1)).alias("n")).groupBy("who", "n").agg(F.min("bucket").alias("bucket"))
    members = store(members.join(same.select("bucket"), "bucket", "left_semi"), "open")
    body = _bodies(docs, members.select("doc_id"))
    full = members.join(classes.select("doc_id", "signature"), "doc_id").join(body, "doc_id")
    own = full.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "part", "signature", "text")

    def links(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own_, ids = table.column("own").to_numpy(), table.column("doc_id").to_numpy()
        part = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
        pairs = []
        for x in left:
            agree = (sig[right] == sig[x]).mean(axis=1)
            hit = (agree >= LEAST_AGREEMENT) & (part[right] != part[x])
            if i == j:
                hit &= right > x
            pairs.append(np.stack([np.full(int(hit.sum()), x), right[hit], -np.round(agree[hit] * COORDINATES)]).astype(np.int64))
        tried = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), dtype=np.int64)
        tried = tried[:, np.argsort(tried[2], kind="stable")]
        top = list(range(int(part.max()) + 1))

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        hashes, sets, found = WordHashes(), {}, []
        body_ = table.column("text")

        def shingles(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingles_of(body_[x].as_py().encode(), hashes)
            return sets[x]

        for x, y, _ in tried.T.tolist():
            a, b = root(int(part[x])), root(int(part[y]))
            if a != b and similar(shingles(x), shingles(y)):
                top[max(a, b)] = min(a, b)
                found.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
        return pa.table({"a": pa.array([int(f[0]) for f in found], type=pa.int64()), "b": pa.array([int(f[1]) for f in found], type=pa.int64())})

    out = store(dealt.groupBy("bucket", "i", "j").applyInArrow(links, "a long, b long"), "links")
    discard(body, members)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sketch = store(sketches(docs), "sketches")
    sets = sketch.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"))
    classes = sketch.where("n_shingles > 0").join(sets.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    classes = store(classes.select("doc_id", "n_shingles", "signature"), "classes")
    banded = _bands(classes)
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).where("n > 1")
    buckets = store(banded.join(full.select("bucket", "hub"), "bucket"), "buckets")
    stars = buckets.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    tried = store(_agreeing(stars, classes), "stars")
    links = confirm(tried, docs)
    parts = components(links)
    more = _rest(buckets.select("bucket", "doc_id"), parts, classes, docs)
    parts = components(links.union(more))
    named = sets.join(parts, F.col("first") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "first").alias("part"))
    out = sketch.select("doc_id", "n_shingles", "set_a", "set_b").join(
        named.select(F.col("set_a").alias("x"), F.col("set_b").alias("y"), "part"),
        (F.col("set_a") == F.col("x")) & (F.col("set_b") == F.col("y")), "left")
    alone = (F.col("n_shingles") == 0) | F.col("part").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("part")).alias("component_id"))


def near_report(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``, whatever their names; a repeated id stays once."""
    return under_plain_names(docs, ("doc_id", "text"), _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    found = near_report(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    once = docs.dropDuplicates(["doc_id"])
    return once.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
