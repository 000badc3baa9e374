"""Phrase collocation mining with stripes.

Texts, with A-Z lower-cased, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. All counts are per language
(null: ``und``): n, the words; f(phrase), the contiguous occurrences of a phrase within pieces, overlaps included. Candidates are phrases of
2 to 4 words with f at least ``LEAST``; see ``score`` for their cuts and ``collocations`` for what is dropped and returned.

* *Stripes.* A prefix of 0 to 3 words keys an associative counter of the words that follow it, with one more entry for "no such
  word": the piece ends, or the extension cannot be frequent. Tasks count into stripes and send those; the elementwise sum of a
  prefix's stripes holds three things at once: its entries are the counts of its extensions, its total is the prefix's own count (for the empty
  prefix n), and its largest frequent entry is what the prefix must be compared with to be dropped as part of a longer phrase.
* *Hot prefixes.* A prefix that is one in ``HOT_SHARE`` of all words or more has its stripe cut into segments by a hash of the next word, and so has
  the empty one; there are at most ``HOT_SHARE`` others, which every task is told. Rows hold at most ``STRIPE`` entries. So no row,
  and no task behind the exchange, holds a frequent prefix whole. Segments are summed by a hash aggregate that spills, in
  the stage that receives them.
* *Levels.* A phrase is no more frequent than its parts. Stripes of k words are kept only for frequent prefixes, and their entries only
  where the last k words are frequent too. Which are is told by a bit array over hashes of the frequent phrases: it only lets some
  infrequent ones pass, never stops a frequent one, tests ``PROBES`` bits, and has 16 to 32 bits a phrase up to ``MOST_BITS`` bits (32 MB). Beyond
  some 16 million frequent phrases of one length it lets more pass, which costs traffic and changes no result.

Null and empty texts and texts without words count nothing. A language whose phrases all stay below ``LEAST`` has no rows. Rows that repeat an id, or have
none, all count; ``doc_id`` is not read. Texts of any length are read in slices that end at a piece's end. An empty table gives an empty result.
Other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.llm.common import MIX_A, STEP, mix64, store

LEAST, WORDS = 30, 4
SCALE, SHARE, TOP = 2_000_000, 80, 2000
#: Segments of the empty prefix's stripe and of those of hot prefixes; which are hot.
SEGMENTS, HOT_SEGMENTS, HOT_SHARE = 1024, 64, 10_000
STRIPE = 512
#: Bytes of text a task counts before it sends its stripes, and the text it takes up at a time.
FLUSH, SLICE = 1 << 24, 1 << 20
LEAST_BITS, MOST_BITS, PROBES = 16, 28, 4
SALTS = 64
#: The end of a piece: a byte that UTF-8 has not inside a piece, and in stripes a word that no text has.
_STOP, END, NO_WORD = b"\xff", 0, "\n"
_CLEAN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _STOP * 10 + b" ")
STRIPES = "lang string, prefix string, segment int, next string, n array<int>"


def slices(text: bytes) -> Iterator[bytes]:
    """The cleaned text in slices that end where a piece ends."""
    text = text.lower().translate(_CLEAN)
    at = 0
    while at < len(text):
        end = text.find(_STOP, at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def numbered(parts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of the slices, ``_STOP`` first, and all words as their numbers, with ``END`` behind each piece."""
    text = _STOP.join([b"", *parts, b""]).replace(_STOP, b" \xff ")
    found = pc.split_pattern(pa.array([text], type=pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    ids, words = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
    # The text starts with a blank and a stop: number 0 is the empty word, 1 the stop.
    return words[1:], ids[ids > 0] - 1


class Filter:
    """Frequent phrases by bits that their hashes name; the hashes of the hot ones themselves."""

    def __init__(self, bits: int, data: bytes, hot: np.ndarray):
        self.bits, self.data, self.hot = bits, np.frombuffer(data, dtype=np.uint8), hot

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), dtype=bool)
        for probe in range(PROBES):
            left = np.flatnonzero(ok)
            at = place(hashes[left], self.bits, probe)
            ok[left] = self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return ok


def place(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The bit that one of ``PROBES`` tests."""
    h = hashes if not probe else mix64(hashes ^ np.uint64(probe))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def phrase_hashes(words: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases given as one array of word hashes per place."""
    h = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64)
    for w in words:
        h = mix64(h * STEP + w * MIX_A)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def stripe_rows(lang: str, names: list[bytes], ids: np.ndarray, level: int, frequent: Filter | None) -> pa.RecordBatch | None:
    """The stripes of all prefixes of ``level`` words in ``ids``, cut into segments and rows."""
    size, hashes = len(names), word_hashes(names)
    count = len(ids)
    ids = np.concatenate([ids, np.full(level, END)])
    places = [ids[k : k + count] for k in range(level + 1)]

    def hashed(at: np.ndarray, first: int) -> np.ndarray:
        return phrase_hashes([hashes[places[first + k][at]] for k in range(level)], lang)

    at = np.flatnonzero(places[0] != END)
    for p in places[1:level]:
        at = at[p[at] != END]
    if level:
        at = at[frequent.passes(hashed(at, 0))]
    if not len(at):
        return None
    following, code = places[level][at], places[0][at] if level else np.zeros(len(at), dtype=np.int64)
    if level:
        inner = np.flatnonzero(following != END)
        following[inner[~frequent.passes(hashed(at[inner], 1))]] = END
    for p in places[1:level]:  # the prefix as one number, word by word
        code = np.unique(code * size + p[at], return_inverse=True)[1]
    seen = np.zeros(int(code.max()) + 1, dtype=np.int64)
    seen[code] = at  # one place where each prefix stands
    pairs, n = np.unique(code * size + following, return_counts=True)
    code, following = np.divmod(pairs, size)
    heads = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
    at = seen[code[heads]]
    share = np.where(np.isin(hashed(at, 0), frequent.hot), HOT_SEGMENTS, 1) if level else np.array([SEGMENTS])
    share = np.repeat(share, np.diff(np.append(heads, len(code))))
    segment = np.where(following == END, 0, (hashes[following] % share.astype(np.uint64)).astype(np.int64))
    if segment.any():
        order = np.lexsort((segment, code))
        code, following, segment, n = code[order], following[order], segment[order], n[order]
    starts = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(segment) != 0)) + 1])
    inside = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    cuts = np.flatnonzero(inside % STRIPE == 0)
    texts = [NO_WORD, *(w.decode() for w in names[1:])]
    prefix = {c: " ".join([texts[ids[i + k]] for k in range(level)]) for c, i in zip(code[np.sort(heads)].tolist(), at.tolist())}
    limits = np.append(cuts, len(code))
    words = [texts[i] for i in following.tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(cuts), type=pa.string()), pa.array([prefix[c] for c in code[cuts].tolist()], type=pa.string()), pa.array(segment[cuts], type=pa.int32()),
        pa.array([" ".join(words[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())], type=pa.string()),
        pa.ListArray.from_arrays(pa.array(limits, type=pa.int32()), pa.array(n, type=pa.int32()))], names=["lang", "prefix", "segment", "next", "n"])


def stripes(docs: DataFrame, level: int, frequent: Filter | None = None) -> DataFrame:
    """The stripes of every task: lang, prefix, segment, the next words joined by blanks (``NO_WORD``: none) and their counts."""
    given = docs.sparkSession.sparkContext.broadcast((frequent.bits, frequent.data.tobytes(), frequent.hot)) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Filter(*given.value) if given else None
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            got = stripe_rows(lang, *numbered(held.pop(lang)), level, told)
            for at in range(0, got.num_rows if got else 0, 10_000):
                yield got.slice(at, 10_000)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                for part in slices(text.as_py() or b""):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if sum(size.values()) > FLUSH:
                        yield from send(max(size, key=size.get))
        for lang in list(held):
            yield from send(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, STRIPES)


def merged(sent: DataFrame) -> DataFrame:
    """lang, prefix, next and n: the elementwise sums of all stripes of a prefix, summed where their segment arrives.

    Entries below ``LEAST`` are then of no use but for the total: they join the entry without a word (null).
    """
    pairs = F.arrays_zip(F.split("next", " ").alias("next"), F.col("n"))
    entries = sent.repartition("lang", "prefix", "segment").select("lang", "prefix", "segment", F.explode(pairs).alias("e"))
    summed = entries.groupBy("lang", "prefix", "segment", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n"))
    frequent = F.when((F.col("n") >= LEAST) & (F.col("next") != NO_WORD), F.col("next"))
    return summed.groupBy("lang", "prefix", "segment", frequent.alias("next")).agg(F.sum("n").alias("n")).drop("segment")


def totals(entries: DataFrame) -> DataFrame:
    """Per prefix its own count and its most frequent extension that is a candidate (null where none is)."""
    longer = F.when(F.col("next").isNotNull(), F.col("n"))
    return entries.groupBy("lang", "prefix").agg(F.sum("n").alias("total"), F.max(longer).alias("longer"))


def frequent_filter(phrases: DataFrame, level: int, words: int) -> Filter:
    """The bit array of ``phrases`` (lang, phrase, a), of ``words`` words in all.

    Each slice of it is made in one place; it passes the driver once, at most 2**MOST_BITS bits. So do the hot phrases,
    at most ``HOT_SHARE``, as no more phrases of one length than words begin in the texts.
    """
    n = phrases.count()
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 4))

    def hashed(langs: list[str], phrases: list[str]) -> np.ndarray:
        which, split = np.array(langs, dtype=object), [p.encode().split(b" ") for p in phrases]
        out = np.zeros(len(split), dtype=np.uint64)
        for lang in set(langs):
            mine = np.flatnonzero(which == lang)
            out[mine] = phrase_hashes([word_hashes([split[i][k] for i in mine]) for k in range(level)], lang)
        return out

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashed(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place(h, bits, probe) for probe in range(PROBES)]))], names=["at"])

    width = LEAST_BITS  # a slice has 2**16 bits, that is 8 kB

    def packed(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << width, dtype=np.uint8)
        at = rows.column("at").to_numpy()
        own[at & ((1 << width) - 1)] = 1
        return pa.table({"slice": pa.array([int(at[0]) >> width], type=pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], type=pa.binary())})

    spots = phrases.select("lang", "phrase").mapInArrow(places, "at long").distinct().withColumn("slice", F.shiftright("at", width))
    data = bytearray(1 << (bits - 3))
    for r in spots.groupBy("slice").applyInArrow(packed, "slice long, bits binary").toLocalIterator():
        data[r["slice"] << (width - 3) : (r["slice"] + 1) << (width - 3)] = r["bits"]
    hot = phrases.where(F.col("a") >= F.lit(words / HOT_SHARE)).select("lang", "phrase").collect()
    return Filter(bits, bytes(data), hashed([r["lang"] for r in hot], [r["phrase"] for r in hot]) if hot else np.zeros(0, dtype=np.uint64))


def joined_words(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in columns])


def phrase_counts(docs: DataFrame, words: int = WORDS) -> list[tuple[DataFrame, DataFrame]]:
    """Per level k = 0, 1, ...: the frequent phrases of k + 1 words (lang, prefix, next, phrase, a) and the totals of the prefixes of k words."""
    out: list[tuple[DataFrame, DataFrame]] = []
    told, size = None, 0
    for level in range(words):
        entries = store(merged(stripes(docs, level, told)), f"stripes-{level}")
        known = entries.where(F.col("next").isNotNull())
        frequent = known.select("lang", "prefix", "next", joined_words("prefix", "next").alias("phrase"), F.col("n").alias("a"))
        out.append((frequent, totals(entries)))
        if not level:
            size = out[0][1].agg(F.sum("total")).first()[0] or 0
        if level + 1 < words:
            told = frequent_filter(frequent, level + 1, size)
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a / (l + r))`` in whole numbers of up to 38 digits."""
    return F.call_function("div", a.cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)"), (left + right).cast("decimal(20,0)"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language.

    A candidate is cut after each of its first words; the cut of the lowest score counts, the shortest first part on ties. A candidate inside a
    longer one that is at least ``SHARE`` percent as frequent is dropped. It is enough to look one word further: a
    longer phrase still is no more frequent than the one between, which then is a candidate that frequent too.
    """
    levels = phrase_counts(docs)
    n = levels[0][1].select("lang", F.col("total").alias("n"))  # one row a language
    counts = levels[0][0].select("lang", "phrase", "a")
    for frequent, _ in levels[1 : WORDS - 1]:
        counts = counts.unionByName(frequent.select("lang", "phrase", "a"))
    candidates = levels[1][0]
    for frequent, _ in levels[2:]:
        candidates = candidates.unionByName(frequent)
    # A stripe answers for the words behind a phrase; those before it come from the longer phrases by their last words.
    before = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    behind = [t.where("longer IS NOT NULL").select("lang", F.col("prefix").alias("phrase"), "longer") for _, t in levels[2:]]
    ahead = [f.select("lang", before.alias("phrase"), F.col("a").alias("longer")) for f, _ in levels[2:]]
    longer = behind[0]
    for other in behind[1:] + ahead:
        longer = longer.unionByName(other)
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {SHARE} * a")).select("lang", "phrase", "a")
    kept = store(kept, "candidates")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))")})
    parts = store(counts, "parts")
    left, right = (parts.select("lang", F.col("phrase").alias(p), F.col("a").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # Each of a language's parts keeps its own best first, so the last window sees at most SALTS * top rows of a language.
    some = best.withColumn("_part", place).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``collocations``."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM pieces, range(1, len(w) - {k - 2}) t(i)" for k in range(1, WORDS + 1))
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {table}) p
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) g GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c g, range(1, {WORDS}) t(i), range(2, {WORDS}) u(m), c s
  WHERE m < g.k AND i + m - 1 <= g.k AND s.lang = g.lang AND s.phrase = array_to_string(g.w[i:i + m - 1], ' ') AND 100 * g.a >= {SHARE} * s.a
), cut AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, CAST((c.a::HUGEINT * {SCALE}) // (x.a + y.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (c.a::HUGEINT * {SCALE}) // (x.a + y.a), t.i) AS o
  FROM c ANTI JOIN inside USING (lang, phrase), range(1, {WORDS}) t(i), f x, f y
  WHERE t.i < c.k AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(c.w[1:t.i], ' ') AND y.phrase = array_to_string(c.w[t.i + 1:], ' ')
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cut WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
