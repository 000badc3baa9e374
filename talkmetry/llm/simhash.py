"""SimHash near-dedup with pigeonring filtering.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. A document's shingles are its runs of three words, repeats
included (all its words as one shingle if fewer, none without words), each hashed by XXH64 with seed 42. A bit of the fingerprint is 1 if
it is set in over half of the hashes. Fingerprints that differ in ``DISTANCE`` = 3 or fewer bits are linked.

* *Equal fingerprints are one class* and enter the search once; a thousand copies make no pairs.
* *Pigeonring.* The fingerprint is a ring of four segments of 16 bits, so each has a budget of 3/4 differing bits. Of the four differences
  of a linked pair, some run around the ring keeps to its budget at every length: 0 bits in its first segment, at most 1 in the first
  two, 2 in the first three, 3 in all (were every start to overdraw somewhere, the overdrawn stretches would close the ring
  with more than 3 bits). For every start the first two steps make the key of an equi-join: the first segment and the second,
  and the second with one 0 turned into 1, as one of two fingerprints that differ in one bit has the 0. The third step is tested on each
  candidate, the full distance on what is left.
* *Buckets.* A key of 32 bits and the start is a bucket. Buckets above ``BLOCK`` members are cut into blocks by a hash of the fingerprint and
  blocks meet block by block, in separate tasks; no bucket is skipped or cut short. Pairs stay inside the task: it joins what
  they link and sends one link for every fingerprint but the first of each group it found, so links grow with the members and not
  with their pairs.

Null, empty and blank texts have fingerprint zero, which links like any other. Rows that repeat an id keep a fingerprint each and share no
link by the id alone. A null id takes part but names a component only where nothing else does (component_id null). An empty table gives
an empty result. Texts of any length count whole, in pieces of bounded memory. Other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import arrow_map, components, discard, store, texts, words

WIDTH, SEED = 3, 42
DISTANCE, SEGMENTS, BITS = 3, 4, 16
BLOCK = 1024
#: Shingles whose bits are counted at a time.
PIECE = 1 << 16
_LOW = np.uint64((1 << BITS) - 1)


def fingerprint(text: bytes | None) -> int:
    """The 64 majority bits of the hashes of all shingles."""
    w = words(text.lower() if text else text)
    if not w:
        return 0
    joined, span = b" ".join(w), min(WIDTH, len(w))
    sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    ends = np.cumsum(sizes + 1) - 1
    begin, end = (ends - sizes)[: len(w) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(begin), PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + PIECE], end[at : at + PIECE])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def rows(batch: pa.RecordBatch) -> dict:
        got = np.array([fingerprint(t) for t in texts(batch.column("text"))], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": got.view(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


def ring_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: row, key and whether the key is the fingerprint's own.

    A key is ``start << 32 | first segment << 16 | second``; the others have one 0 of the second segment turned into 1.
    """
    row, key, own = [], [], []
    at = np.arange(len(fps))
    for start in range(SEGMENTS):
        first, second = ((fps >> np.uint64(BITS * ((start + i) % SEGMENTS))) & _LOW for i in (0, 1))
        base = np.uint64(start << 32) | first << np.uint64(BITS)
        row.append(at)
        key.append(base | second)
        own.append(np.ones(len(fps), dtype=bool))
        for bit in range(BITS):
            zero = np.flatnonzero(second >> np.uint64(bit) & np.uint64(1) == 0)
            row.append(zero)
            key.append((base | second)[zero] | np.uint64(1 << bit))
            own.append(np.zeros(len(zero), dtype=bool))
    return np.concatenate(row), np.concatenate(key), np.concatenate(own)


def ring_rows(classes: DataFrame) -> DataFrame:
    """key, fp and own for every fingerprint and key."""

    def rows(batch: pa.RecordBatch) -> dict:
        fps = batch.column("fp").to_numpy()
        row, key, own = ring_keys(fps.view(np.uint64))
        return {"key": key.view(np.int64), "fp": fps[row], "own": own}

    return arrow_map(classes.select("fp"), rows, "key long, fp long, own boolean")


def candidates_pass(left: np.ndarray, right: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep to the budget of three segments of the ring from ``start``, then to that of all four."""
    differ = left ^ right
    turn = np.uint64(BITS * start)
    ring = (differ >> turn) | (differ << (np.uint64(64) - turn)) if start else differ
    ok = np.bitwise_count(ring & np.uint64((1 << 3 * BITS) - 1)) <= 3 * DISTANCE // SEGMENTS
    ok[ok] = np.bitwise_count(differ[ok]) <= DISTANCE
    return ok


def bucket_links(key: int, fps: np.ndarray, own: np.ndarray, side: np.ndarray, diagonal: bool) -> list[tuple[int, int]]:
    """A spanning set of the links between the members of two blocks of one bucket.

    Own members meet all members; two members that both had a bit turned differ from each other elsewhere and meet
    under another key. ``side`` is 0 for the first block and 1 for the second; on the diagonal there is only one.
    """
    start = key >> 32
    part = np.arange(len(fps))
    everyone = np.arange(len(fps))
    out = []
    for x in np.flatnonzero(own).tolist():
        other = ~own | (everyone > x) if diagonal else (side != side[x]) & (~own | (side[x] == 0))
        other = everyone[other & (part != part[x])]
        near = other[candidates_pass(fps[x : x + 1], fps[other], start)]
        if len(near):
            met, one = np.unique(part[near], return_index=True)
            out += [(x, y) for y in near[one].tolist()]
            part[np.isin(part, met)] = part[x]
    return out


def _link_tasks(dealt: DataFrame) -> DataFrame:
    """Links (a, b) of every (key, i, j), whose rows arrive together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ready, held = _complete(held)
            yield _solve(ready)
        if held is not None:
            yield _solve(held)

    return dealt.mapInArrow(run, "a long, b long")


def _group_starts(table: pa.Table) -> np.ndarray:
    cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
    change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1]) if table.num_rows else np.zeros(0, dtype=np.int64)


def _complete(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The groups that are surely whole, and the last one, which the next batch may continue."""
    starts = _group_starts(table)
    last = int(starts[-1]) if len(starts) else 0
    return table.slice(0, last), table.slice(last).combine_chunks()


def _solve(table: pa.Table) -> pa.RecordBatch:
    fps, keys = table.column("fp").to_numpy().view(np.uint64), table.column("key").to_numpy()
    own, block, i, j = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "block", "i", "j"))
    starts = _group_starts(table)
    ends = np.append(starts[1:], table.num_rows)
    found: list[tuple[int, int]] = []
    alone = (ends - starts < 2) | (np.add.reduceat(own, starts, dtype=np.int64) == 0 if len(starts) else True)
    for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist()):
        for x, y in bucket_links(int(keys[a]), fps[a:b], own[a:b], (block[a:b] == j[a]).astype(int), bool(i[a] == j[a])):
            found.append((a + x, a + y))
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    signed = fps.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[at[:, 0]]), pa.array(signed[at[:, 1]])], names=["a", "b"])


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are linked, directly or through others."""
    ring = ring_rows(classes)
    large = ring.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    blocks = store(large.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    # A stored table: Spark broadcasts it or not by its true size.
    sized = ring.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "fp", "own")
    out = store(_link_tasks(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")), "links")
    discard(blocks)
    return out


def near_fingerprints(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint in 16 hex digits, and component_id of every document."""
    printed = store(fingerprints(docs), "fingerprints")
    classes = store(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts = components(links(classes, block))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    # Only parts of several fingerprints need another id than the first of their own one.
    lowest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "part").select(F.col("fp").alias("_fp"), "component_id")
    hexes = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return printed.join(named, F.col("fp") == F.col("_fp")).select("doc_id", hexes.alias("fingerprint"), "component_id")
