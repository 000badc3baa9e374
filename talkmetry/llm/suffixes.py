"""Suffix-array dedup: remove bytes of 100-byte strings that also start earlier, by a distributed string merge sort.

Every text is UTF-8 bytes (null: empty). Positions are ordered by (doc_id, offset), a null id last; of rows that repeat an id one counts as
earlier. A byte goes if a ``SPAN``-byte string covers it that also starts at an earlier position. Matches never cross documents.

* *Sparse suffixes.* The ``SPAN``-byte windows of a text fall into runs that share a minimum of the hashes of their
  ``GRAM``-byte strings, about one run for 37 bytes. Equal windows have equal minima, so runs meet where windows could.
  A run's suffixes are sorted as one string: its minimum, then the bytes of all its windows.
* *Distinguishing first.* Each chunk of texts sends its sorted minima; those met once in the corpus belong to unique windows, and their
  runs go no further. The answer comes back as one byte per minimum.
* *Exchange.* A chunk merges its equal strings, sorts the rest and sends each range of minima as a front-coded run: length of the
  prefix shared with the string before, then the remaining bytes.
* *Merge.* A loser tree merges the runs of a range. Every string knows its common prefix with the last output, so two of them are
  compared by that number; bytes are read only beyond it, where the numbers are equal (``LoserTree``).
* *Verdict.* Of equal strings all but the earliest are covered. Different strings with one minimum may still share windows: those are ranked window
  by window. Verdicts return to the chunks, which cut the bytes.

A minimum with more than ``HOT`` different strings (the edge of a passage in a great many documents) is cut into single windows that
are dealt by their own hash, in all chunks alike. Work units are chunks of ``CHUNK`` bytes and ranges of minima; their numbers grow with the input.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import MASK64, STEP, mix64, rows_and_bytes, store, texts

SPAN, GRAM = 100, 32
CHUNK = 4 << 20
#: Bytes of text behind one range of minima, on average.
RANGE = 16 << 20
HOT = 50_000
#: Windows of a run, at most: longer runs (repeated words) are cut from their start.
MOST = 138
_BLOCK = 1 << 19
_BYTES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.iinfo(np.int64).max
_PACK = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-byte strings, by doubling."""
    h, width, step = _BYTES[data], 1, int(STEP)
    while width * 2 <= size:
        n = max(0, len(h) - width)
        h = h[:n] * np.uint64(step) + h[width : width + n]
        step = step * step & MASK64
        width *= 2
    if width < size:  # two overlapping strings make the longer one
        n = max(0, len(h) - (size - width))
        h = h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[size - width : size - width + n]
    return mix64(h)


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[: max(0, len(h) - size)], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: max(0, len(h) - rest)], h[rest:]) if rest else h


def runs_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, 48-bit minimum, holds its minimum twice) of the runs of texts laid end to end."""
    ends = np.cumsum(lengths)
    found: list[tuple[np.ndarray, ...]] = []
    first = 0
    while first < len(lengths):  # blocks of whole texts; a long text is cut into overlapping blocks
        last = first + 1
        begin = int(ends[first] - lengths[first])
        while last < len(lengths) and ends[last] - begin <= _BLOCK:
            last += 1
        stop = int(ends[last - 1])
        at = begin
        while at < stop:
            to = min(stop, at + 2 * _BLOCK)
            found.append(_block_runs(data[at:to], at, ends[first:last]))
            at = stop if to == stop else to - SPAN + 1
        first = last
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _block_runs(data: np.ndarray, offset: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    grams, width = string_hashes(data, GRAM) >> np.uint64(16), SPAN - GRAM + 1
    least = _window_minima(grams, width)
    at = np.arange(len(least)) + offset
    inside = at + SPAN <= ends[np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)]
    at, least = at[inside], least[inside]
    if not len(at):
        return at, at, least, np.zeros(0, dtype=bool)
    # A gram that is the minimum of some window equals the largest minimum of the windows around it.
    edge = np.zeros(width - 1, dtype=np.uint64)
    around = ~_window_minima(~np.concatenate([edge, _window_minima(grams, width), edge]), width)
    spot = np.flatnonzero(grams == around)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(at) != 1)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    pieces = -(-size // MOST)
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(start)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = start[which] + k * MOST, np.minimum(MOST, size[which] - k * MOST)
    start, size, least = at[start], size, least[start]
    values, rank = np.unique(grams[spot], return_inverse=True)
    sites = np.sort(rank * len(data) + spot)
    mine = np.searchsorted(values, least) * len(data) + start - offset
    twice = np.searchsorted(sites, mine + size + width - 1) - np.searchsorted(sites, mine) > 1
    return start, size, mix64(least) >> np.uint64(16), twice  # minima are small numbers: spread them over all ranges


class LoserTree:
    """Merges sorted iterators of (common prefix with the string before, string) in order, equal strings in a row.

    A player is (prefix shared with the last output, string). The longer that prefix, the smaller the string, so
    unequal prefixes decide a match without a look at the strings; equal ones are compared from that byte on, and the
    loser keeps the prefix it shares with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self._runs = runs
        size = 1
        while size < max(1, len(runs)):
            size *= 2
        self._size = size
        self._prefix = [-1] * size  # -1: the run has ended, and loses against all others
        self._string: list[bytes] = [b""] * size
        self._loser = [0] * size
        for i, run in enumerate(runs):
            head = next(run, None)
            if head is not None:
                self._prefix[i], self._string[i] = 0, head[1]
        self._winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self._size:
            return node - self._size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self._loser[node] = self._match(a, b)
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        prefix = self._prefix
        h = prefix[a]
        if h != prefix[b]:
            return (a, b) if h > prefix[b] else (b, a)
        if h < 0:
            return a, b
        x, y = self._string[a], self._string[b]
        if x == y:
            prefix[b] = len(y)
            return a, b
        while x[h : h + 16] == y[h : h + 16]:
            h += 16
        most = min(len(x), len(y))
        while h < most and x[h] == y[h]:
            h += 1
        if h == len(x) or h < len(y) and x[h] < y[h]:
            prefix[b] = h
            return a, b
        prefix[a] = h
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, prefix shared with the output before, string)."""
        prefix, string, loser, size, runs = self._prefix, self._string, self._loser, self._size, self._runs
        w = self._winner
        while prefix[w] >= 0:
            yield w, prefix[w], string[w]
            head = next(runs[w], None)
            prefix[w], string[w] = head if head is not None else (-1, b"")
            node = (w + size) >> 1
            while node:
                other = loser[node]
                if prefix[other] > prefix[w]:
                    loser[node], w = w, other
                elif prefix[other] == prefix[w]:
                    w, loser[node] = self._match(w, other)
                node >>= 1


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefixes, lengths of the rest, the rests) of sorted strings."""
    if not strings:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint16), b""
    size = np.array([len(s) for s in strings])
    width = int(size.max())
    table = np.zeros((len(strings), width + 1), dtype=np.uint8)
    cells = np.arange(width + 1)[None, :] < size[:, None]
    table[cells] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    equal = table[1:] == table[:-1]
    shared = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    shared = np.concatenate([[0], np.minimum(shared, np.minimum(size[1:], size[:-1]))])
    cells &= np.arange(width + 1)[None, :] >= shared[:, None]
    return shared.astype(np.uint16), (size - shared).astype(np.uint16), table[cells].tobytes()


def read_front_coded(shared: np.ndarray, rest: np.ndarray, body: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 0, b""
    for h, n in zip(shared.tolist(), rest.tolist()):
        last = last[:h] + body[at : at + n]
        at += n
        yield h, last


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return _PACK.compress(struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts))


def unpack(blob: bytes) -> list[bytes]:
    raw = _OPEN.decompress(blob)
    (n,) = struct.unpack_from("<Q", raw)
    sizes = struct.unpack_from(f"<{n}Q", raw, 8)
    at, out = 8 * (n + 1), []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


class Chunk:
    """Texts of one chunk, end to end in order of their ids, with their runs."""

    def __init__(self, blob: bytes):
        ids, null, lengths, body = unpack(blob)
        self.ids, self.null = np.frombuffer(ids, dtype=np.int64), np.frombuffer(null, dtype=bool)
        self.lengths, self.body = np.frombuffer(lengths, dtype=np.int64), body
        self.data = np.frombuffer(body, dtype=np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.start, self.size, self.least, self.twice = runs_of(self.data, self.lengths)
        self.minima, self.which, self.count = np.unique(self.least, return_inverse=True, return_counts=True)
        self.count[self.which[self.twice]] += 1

    @staticmethod
    def make(rows: list[tuple[int | None, bytes]]) -> bytes:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        ids = np.array([_LAST if i is None else i for i, _ in rows], dtype=np.int64)
        return pack(ids, np.array([i is None for i, _ in rows], dtype=bool), np.array([len(t) for _, t in rows], dtype=np.int64), b"".join(t for _, t in rows))

    def strings(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """The runs that may repeat: starts, sizes, class of each; the classes' strings, sorted, their first starts, and
        whether they may repeat a window within themselves."""
        flag = flags[self.which]
        start, size, least, twice = (a[flag > 0] for a in (self.start, self.size, self.least, self.twice))
        if (flag == 2).any():  # hot minima: every window by itself
            hot = flag[flag > 0] == 2
            which = np.repeat(np.flatnonzero(hot), size[hot])
            k = np.arange(len(which)) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot])
            at = start[which] + k
            cells = self.data[at[:, None] + np.arange(SPAN)[None, :]] if len(at) else np.zeros((0, SPAN), dtype=np.uint8)
            own = np.array([int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=6).digest(), "big") for c in cells], dtype=np.uint64)
            single = np.ones(len(at), dtype=np.int64)
            start, size, least, twice = (np.concatenate(x) for x in ((start[~hot], at), (size[~hot], single), (least[~hot], own), (twice[~hot], single < 1)))
            order = np.argsort(start, kind="stable")
            start, size, least, twice = (x[order] for x in (start, size, least, twice))
        heads = least.astype(">u8").tobytes()
        body = self.body
        known: dict[bytes, int] = {}
        keys = [heads[8 * i + 2 : 8 * i + 8] + body[a : a + n + SPAN - 1] for i, (a, n) in enumerate(zip(start.tolist(), size.tolist()))]
        for i, k in enumerate(keys):
            known.setdefault(k, i)
        ordered = sorted(known)
        place = {k: i for i, k in enumerate(ordered)}
        classes = np.array([place[k] for k in keys], dtype=np.int64)
        lead = np.array([known[k] for k in ordered], dtype=np.int64)
        return start, size, classes, ordered, start[lead], twice[lead]

    def positions(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc id, offset) of places in the chunk."""
        doc = np.searchsorted(self.ends, start, side="right")
        return self.ids[doc], start - (self.ends[doc] - self.lengths[doc])


SENT = "range int, chunk long, data binary"
_SENT = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
CHUNKS = "chunk long, blob binary"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _cut(minima: np.ndarray, bits: int) -> np.ndarray:
    """First index of each of the ``2 ** bits`` ranges in sorted minima, and the end."""
    limits = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48 - bits)
    return np.concatenate([[0], np.searchsorted(minima, limits, side="left"), [len(minima)]])


def chunks_of(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(chunk, blob): texts packed as they are read, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, bytes]] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            blob = Chunk.make(rows)
            name = (TaskContext.get().partitionId() << 32) + made  # kept by the stored table
            made += 1
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([name], type=pa.int64()), pa.array([blob], type=pa.binary())], schema=_CHUNKS)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                rows.append((i, text or b""))
                size += len(text or b"")
                if size >= chunk_bytes:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


def _send_minima(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                c = Chunk(blob)
                six = np.ascontiguousarray(c.minima.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                count = np.minimum(c.count, 255).astype(np.uint8)
                cut = _cut(c.minima, bits)
                rows = [(r, name, pack(six[a:b], count[a:b])) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
                if rows:
                    yield from _rows(_SENT, rows).to_batches()

    return chunks.mapInArrow(run, SENT)


def _repeated(sent: pa.Table, hot: int) -> pa.Table:
    """For every chunk's minima of one range: 0 met once in the corpus, 1 repeated, 2 repeated and hot."""
    names = sent.column("chunk").to_pylist()
    got = [unpack(b) for b in sent.column("data").to_pylist()]
    sizes = [len(g[1]) for g in got]
    six = np.frombuffer(b"".join(g[0] for g in got), dtype=np.uint8).reshape(-1, 6)
    minima = np.zeros((len(six), 8), dtype=np.uint8)
    minima[:, :6] = six
    minima = minima.reshape(-1).view("<u8")
    count = np.frombuffer(b"".join(g[1] for g in got), dtype=np.uint8).astype(np.int64)
    order = np.argsort(minima, kind="stable")
    new = np.concatenate([[True], np.diff(minima[order]) != 0])
    total = np.add.reduceat(count[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    flag = np.empty(len(minima), dtype=np.uint8)
    flag[order] = np.where(total > hot, 2, total > 1)
    r = sent.column("range")[0].as_py()
    ends = np.cumsum([0, *sizes])
    return _rows(_SENT, [(r, n, pack(flag[ends[i] : ends[i + 1]])) for i, n in enumerate(names)])


def _flags(sent: pa.Table, size: int) -> np.ndarray:
    order = np.argsort(sent.column("range").to_numpy())
    data = sent.column("data").to_pylist()
    flags = b"".join(unpack(data[i])[0] for i in order)
    assert len(flags) == size
    return np.frombuffer(flags, dtype=np.uint8)


def _send_strings(chunk: pa.Table, flags: pa.Table, bits: int) -> pa.Table:
    if not chunk.num_rows:
        return _rows(_SENT, [])
    c = Chunk(chunk.column("blob")[0].as_py())
    _, _, _, strings, first, twice = c.strings(_flags(flags, len(c.minima)))
    doc, offset = c.positions(first)
    heads = np.array([int.from_bytes(s[:6], "big") for s in strings], dtype=np.uint64)
    cut = _cut(heads, bits).tolist()
    name = chunk.column("chunk")[0].as_py()
    return _rows(_SENT, [(r, name, pack(*front_code(strings[a:b]), doc[a:b], offset[a:b], twice[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a])


def _judge(sent: pa.Table) -> pa.Table:
    """Merge the runs of one range; per run, what is covered of each string: 0 nothing, 1 all, 2 the windows given."""
    names = sent.column("chunk").to_pylist()
    got = [unpack(b) for b in sent.column("data").to_pylist()]
    runs, docs, offsets, twices = [], [], [], []
    for shared, rest, body, doc, offset, twice in got:
        runs.append(read_front_coded(np.frombuffer(shared, dtype=np.uint16), np.frombuffer(rest, dtype=np.uint16), body))
        docs.append(np.frombuffer(doc, dtype=np.int64))
        offsets.append(np.frombuffer(offset, dtype=np.int64))
        twices.append(np.frombuffer(twice, dtype=bool))
    base = np.cumsum([0, *map(len, docs)])
    doc, offset = np.concatenate(docs), np.concatenate(offsets)
    taken = [int(b) for b in base[:-1]]
    classes: list[bytes] = []
    entry, klass = np.empty(len(doc), dtype=np.int64), np.empty(len(doc), dtype=np.int64)
    for n, (run, shared, string) in enumerate(LoserTree(runs)):
        if not classes or shared < len(string) or len(string) != len(classes[-1]):
            classes.append(string)
        entry[n] = taken[run]
        klass[n] = len(classes) - 1
        taken[run] += 1
    order = np.lexsort((entry, offset[entry], doc[entry], klass))
    lead = entry[order[np.concatenate([[True], np.diff(klass[order]) != 0])]]
    state = np.ones(len(doc), dtype=np.uint8)
    state[lead] = 0
    head = np.array([int.from_bytes(s[:6], "big") for s in classes], dtype=np.uint64)
    same = np.concatenate([[False], head[1:] == head[:-1]])
    several = np.flatnonzero(same | np.append(same[1:], False) | np.concatenate(twices)[lead])
    windows: dict[int, np.ndarray] = {}
    if len(several):
        for k, covered in _rank_windows([classes[i][6:] for i in several], head[several], doc[lead[several]], offset[lead[several]]):
            if covered.any():
                e = int(lead[several[k]])
                state[e] = 1 if covered.all() else 2
                windows[e] = covered
    rows = []
    r = sent.column("range")[0].as_py()
    for i, name in enumerate(names):
        part = state[base[i] : base[i + 1]]
        bits = [windows[e + int(base[i])] for e in np.flatnonzero(part == 2).tolist()]
        rows.append((r, name, pack(part, np.packbits(np.concatenate(bits) if bits else np.zeros(0, dtype=bool)))))
    return _rows(_SENT, rows)


def _rank_windows(strings: list[bytes], head: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(string, per window whether the same window of the same minimum starts earlier)."""
    size = np.array([len(s) for s in strings])
    ends = np.cumsum(size)
    h = string_hashes(np.frombuffer(b"".join(strings), dtype=np.uint8), SPAN)
    at = np.arange(len(h))
    owner = np.searchsorted(ends, at, side="right")
    inside = at + SPAN <= ends[owner]
    at, owner = at[inside], owner[inside]
    key = mix64(h[inside] ^ mix64(head[owner]))
    place = offset[owner] + at - (ends[owner] - size[owner])
    order = np.lexsort((place, doc[owner], key))
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    covered = np.empty(len(at), dtype=bool)
    covered[order] = ~first
    cut = np.concatenate([[0], np.cumsum(size - SPAN + 1)])
    for k in range(len(strings)):
        yield k, covered[cut[k] : cut[k + 1]]


def removed_bytes(c: Chunk, flags: np.ndarray, answers: list[list[bytes]]) -> np.ndarray:
    """Mask of the chunk's bytes that go, from the verdicts of all ranges in order."""
    start, size, klass, strings, first, _ = c.strings(flags)
    change = np.zeros(len(c.data) + 1, dtype=np.int32)
    if not len(start):
        return change[:-1] > 0
    width = np.array([len(s) - 6 - SPAN + 1 for s in strings], dtype=np.int64)
    states, bits, done = [], [], 0
    for state_, packed in answers:  # packed bits end on whole bytes: each range's bits are cut to its windows
        state = np.frombuffer(state_, dtype=np.uint8)
        n = int(width[done : done + len(state)][state == 2].sum())
        states.append(state)
        bits.append(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).astype(bool))
        done += len(state)
    del strings
    state, bit = np.concatenate(states), np.concatenate(bits)
    whole = (first[klass] != start) | (state[klass] == 1)
    np.add.at(change, start[whole], 1)
    np.add.at(change, start[whole] + size[whole] + SPAN - 1, -1)
    part = np.flatnonzero(state == 2)
    at = np.repeat(first[part], width[part]) + np.arange(len(bit)) - np.repeat(np.cumsum(width[part]) - width[part], width[part])
    np.add.at(change, at[bit], 1)
    np.add.at(change, at[bit] + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    if not chunk.num_rows:
        return _rows(_RESULT, [])
    c = Chunk(chunk.column("blob")[0].as_py())
    kind = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0)
    back = answers.filter(pa.array(kind == 1))
    data = back.column("data").to_pylist()
    verdicts = [unpack(data[i]) for i in np.argsort(back.column("range").to_numpy())]
    gone = removed_bytes(c, _flags(answers.filter(pa.array(kind == 0)), len(c.minima)), verdicts)
    rows = []
    for i, (end, length) in enumerate(zip(c.ends.tolist(), c.lengths.tolist())):
        mine = gone[end - length : end]
        n = int(mine.sum())
        spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
        kept = c.data[end - length : end][~mine].tobytes() if n else c.body[end - length : end]
        rows.append((None if c.null[i] else int(c.ids[i]), length, n, spans, hashlib.sha256(kept).hexdigest()))
    return _rows(_RESULT, rows)


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK, range_bytes: int = RANGE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    _, size = rows_and_bytes(docs, "text")
    bits = max(0, (size // range_bytes).bit_length())
    chunks = store(chunks_of(docs, chunk_bytes), "chunks")
    flags = store(_send_minima(chunks, bits).groupBy("range").applyInArrow(lambda t: _repeated(t, hot), SENT), "flags")
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(lambda c, f: _send_strings(c, f, bits), SENT)
    verdicts = sent.groupBy("range").applyInArrow(_judge, SENT)
    answers = flags.withColumn("kind", F.lit(0)).union(verdicts.withColumn("kind", F.lit(1)))
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_finish, RESULT)
