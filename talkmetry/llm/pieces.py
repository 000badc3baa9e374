"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; ``parse_model`` reads the fields that matter. ``build`` makes the same
tokenizer of the other library's parts: the precompiled normaliser, the space marker, unigram scores or merges, and byte
fallback. A BPE model keeps only scores, so its merges are every split of a piece into two pieces, best piece first. Where no
piece of the vocabulary holds the marker behind another character, text is cut in front of markers first: no
merge can cross such a cut, and words are then remembered by the library.

The model file is read on the executors from ``MODEL_FILE`` (the ``model`` parameter elsewhere); it is never copied. Batches
are cut by bytes, so memory does not follow the number of rows; the library encodes a batch on ``THREADS`` threads.
Null text counts as empty: no ids, and a round trip that holds.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Bytes of text in one call of the library.
CALL_BYTES = 1 << 19
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of every field of a protobuf message: an int, 4 or 8 raw bytes, or the bytes of a string."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            got = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0], got[3]))
        elif number == 2:
            got = {3: UNIGRAM, 35: 0, 40: 0} | dict(_fields(value))
            model.kind, model.byte_fallback, model.unknown = got[3], bool(got[35]), got[40]
        elif number == 3:
            got = {2: b"", 3: 1, 4: 1, 5: 1} | dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.collapse_spaces, model.escape_spaces = got[2], bool(got[3]), bool(got[4]), bool(got[5])
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Splits of every ordinary piece into two pieces, by falling score of the whole, then by the parts' ids."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def build(model: Model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the model."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if model.kind == BPE:
        vocabulary = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"unsupported model kind {model.kind}")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoder_of(model, strip=model.dummy_prefix)
    return out


def decoder_of(model: Model, strip: bool):
    from tokenizers import decoders

    return decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if strip else [])])


_BUILT: dict[str, tuple] = {}


def load(path: str = MODEL_FILE):
    """(parsed model, tokenizer, word encoder, the other library's processor) of a model file, built once per Python worker."""
    if path not in _BUILT:
        with open(path, "rb") as f:  # a local file of every machine, like the library itself
            model = parse_model(f.read())
        other = reference(path)
        _BUILT[path] = model, build(model), WordEncoder(model, other), other
    return _BUILT[path]


def reference(path: str = MODEL_FILE):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def normalised(model: Model, text: str) -> str:
    """What decoding gives back: the text itself, unless the model's normaliser changes it."""
    if model.charsmap:
        from tokenizers import normalizers

        text = normalizers.Precompiled(model.charsmap).normalize_str(text)
    if model.collapse_spaces:
        text = " ".join(x for x in text.split(" ") if x)
    return text.replace(MARKER, " ") if model.escape_spaces else text


def _batches(rows: list[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    part, size = [], 0
    for text in rows:
        part.append(text)
        size += len(text) + 64
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_whole(tokenizer, rows: list[str]) -> Iterator[list[int]]:
    """Ids of every text, whole texts in batches, several threads at a time."""
    for part in _batches(rows):
        for got in tokenizer.encode_batch_fast(part, add_special_tokens=False):
            yield got.ids


class WordEncoder:
    """Encodes texts word by word, each distinct word once, and checks each: it decodes to itself, and the other
    library gives the same ids."""

    def __init__(self, model: Model, other, limit: int = 800_000):
        from tokenizers import Tokenizer

        whole = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        single = "".join(c for c in "\n\t\r" if not any(c in p for p in whole if len(p) > 1))
        self.exact = (
            model.kind == BPE and model.byte_fallback and not model.charsmap and not model.collapse_spaces and "\n" in single
            and model.dummy_prefix and model.escape_spaces and not any(MARKER in p.lstrip(MARKER) for p in whole)
        )
        self._cut = re.compile(f"[{single}]| *[^ {single}]+| +" if single else " *[^ ]+| +")
        self._core = Tokenizer(build(model).model)
        self._core.decoder = decoder_of(model, strip=False)
        self._other, self._limit = other, limit
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, bytes] = {}
        self._odd: set[str] = set()
        self._unlike: set[str] = set()

    def _learn(self, new: list[str]) -> None:
        for part in _batches(new, CALL_BYTES << 2):
            got = [x.ids for x in self._core.encode_batch_fast([w.replace(" ", MARKER) for w in part], add_special_tokens=False)]
            self._known.update(zip(part, [array("i", x).tobytes() for x in got]))
            back = self._core.decode_batch(got, skip_special_tokens=False)
            if back != part:
                self._odd.update(w for w, b in zip(part, back) if w != b)
            if self._other is not None:
                self._compare(part, got)

    def _compare(self, part: list[str], got: list[list[int]]) -> None:
        """All words at once, each behind a line break; one by one only if that differs."""
        space, line = (self._core.encode(x, add_special_tokens=False).ids for x in (MARKER, "\n"))
        want = space + [i for ids in got for i in chain(line, ids)]
        if self._other.encode("\n" + "\n".join(part)) != want:
            theirs = self._other.encode(["\n" + w for w in part], num_threads=1)
            self._unlike.update(w for w, ids, x in zip(part, got, theirs) if space + line + ids != x)

    def __call__(self, rows: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of every text; whether they decode to it; whether they are the other library's."""
        cut = self._cut.findall
        split = [cut(" " + t.replace(MARKER, " ")) if t else [] for t in rows]
        if len(self._known) > self._limit:
            self._forget()
        known = self._known
        new: set[str] = set()
        for ws in split:
            new.update(ws)
        self._learn(list(new.difference(known)))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype=np.int32) for ws in split]
        same, alike = ([not odd or odd.isdisjoint(ws) for ws in split] for odd in (self._odd, self._unlike))
        return ids, same, alike


def encode(docs: DataFrame, model: str = MODEL_FILE, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding gives the normalised text back) and parity (the sentencepiece
    library agrees) of every document."""
    schema = StructType.fromDDL("doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        parsed, tokenizer, by_word, other = load(model)
        for batch in batches:
            at = 0
            for part in _batches([t or "" for t in batch.column("text").to_pylist()], 4 * CALL_BYTES):
                if by_word.exact:
                    ids, same, alike = by_word(part)
                else:
                    ids = [np.array(x, dtype=np.int32) for x in encode_whole(tokenizer, part)]
                    back = tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                    same = [got == normalised(parsed, text) for got, text in zip(back, part)]
                    alike = [x.tolist() == y for x, y in zip(ids, other.encode(part, num_threads=1))]
                ends = np.cumsum([0] + [len(x) for x in ids])
                column = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(ids), type=pa.int32()))
                out = [batch.column("doc_id").slice(at, len(part)), pa.array(np.diff(ends), type=pa.int64()), column.cast(arrow.field("ids").type), pa.array(same, type=pa.bool_())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(alike, type=pa.bool_())], schema=arrow)
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""
    schema = StructType.fromDDL("doc_id long, text string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)[1]
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            got = [None if x is None else tokenizer.decode(x, skip_special_tokens=False) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, type=arrow.field("text").type)], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def encode_report(docs: DataFrame, model: str = MODEL_FILE) -> DataFrame:
    """``encode`` with the ids as a digest: SHA-256 of their decimal forms, separated by commas."""
    out = encode(docs, model)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip", "parity")
