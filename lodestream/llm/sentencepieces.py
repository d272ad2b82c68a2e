"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer; its wire format is read here directly: pieces with scores
and kinds, the trainer's settings (model type, ids, byte fallback) and the normaliser's.  From
these a ``tokenizers.Tokenizer`` is rebuilt (unigram scores, or merges ranked by score for BPE
models), which encodes batches with several threads.  Ids are compared with those of the
sentencepiece library for every text.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded each; other columns stay as they are, but for those with the names of the added ones.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import plain, table

MODEL = os.environ.get("LODESTREAM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
THREADS = 2
BATCH, BATCH_CHARS = 256, 1_000_000
SPACE = "▁"
#: Kinds of pieces and model types in the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers of varints, bytes of the rest."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        else:
            n, at = _varint(b, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = b[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    """The parts of a model file that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            got = dict(fields(value))
            m.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(fields(value))
            m.kind, m.byte_fallback, m.unk_id = got.get(3, UNIGRAM), bool(got.get(35, 0)), got.get(40, 0)
        elif number == 3:
            got = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score of the result first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = ids.get(p[:k]), ids.get(p[k:])
            if a is not None and b is not None:
                found.append((-m.pieces[i][1], i, a, b))
    return [(m.pieces[a][0], m.pieces[b][0]) for _, _, a, b in sorted(found)]


def rebuild(m: Model) -> Tokenizer:
    names = [p for p, _, _ in m.pieces]
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        core = models.BPE(dict(zip(names, range(len(names)), strict=True)), merges(m), unk_token=names[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is not supported")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]  # spaces only: other blanks are characters
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if border := borders(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(border), "isolated")
    undo = [decoders.Replace(SPACE, " ")] if m.escape else []
    undo += ([decoders.ByteFallback()] if m.byte_fallback else []) + [decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])
    t.decoder = decoders.Sequence(undo)
    t.encode_special_tokens = True
    return t


def borders(m: Model) -> str:
    """Pattern of the parts of a normalised text that can be encoded apart; empty if there is none.

    If no piece has the marker after another character, nothing merges across that border; a
    line feed that is in no longer piece is a border likewise.
    """
    usable = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
    if m.kind != BPE or not m.escape or any(SPACE in p.lstrip(SPACE) for p in usable):
        return ""
    if any("\n" in p for p in usable):
        return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
    return f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"


class Codec:
    """Encodes and decodes batches; one a worker process.

    Words already seen come from a table of at most TABLE words of at most LONGEST characters (emptied
    when full, so memory is bounded and results do not depend on it); the others of a batch are encoded together by the
    library's threads.
    """

    TABLE, LONGEST = 300_000, 64

    def __init__(self, path: str, threads: int):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.whole = rebuild(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.border = re.compile(borders(self.model)) if borders(self.model) else None
        self.words = Tokenizer(self.whole.model)
        self.words.encode_special_tokens = True
        self.seen: dict[str, bytes] = {}
        self.text_of = [self.piece_bytes(p, kind) for p, _, kind in self.model.pieces]

    def piece_bytes(self, piece: str, kind: int) -> bytes | None:
        """What a piece adds to a decoded text; None if only the library's decoder is to say."""
        if kind == BYTE and self.model.byte_fallback:
            return bytes([int(piece[1:-1], 16)])
        return (piece.replace(SPACE, " ") if self.model.escape else piece).encode() if kind in (NORMAL, USER_DEFINED, UNUSED) else None

    def normalized(self, text: str) -> str:
        m = self.model
        if m.charsmap or m.squeeze:
            return self.whole.normalizer.normalize_str(text)
        text = f"{' ' * m.dummy_prefix}{text}" if text else text
        return text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.border is None:
            return [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.border.findall(self.normalized(t)) for t in texts]
        if len(self.seen) > self.TABLE:
            self.seen = {}
        new = list({w for p in parts for w in p if w not in self.seen})
        for at in range(0, len(new), 65536):
            for w, e in zip(new[at : at + 65536], self.words.encode_batch_fast(new[at : at + 65536], add_special_tokens=False), strict=True):
                self.seen[w] = array("i", e.ids).tobytes()
        ids = self.seen
        found = [np.frombuffer(b"".join([ids[w] for w in p]), "<i4") for p in parts]
        for w in new:
            if len(w) > self.LONGEST:
                del ids[w]
        return found

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Joined bytes of the pieces; ids of other pieces and broken UTF-8 go through the library's decoder."""
        out = []
        for x in ids:
            try:
                text = b"".join([self.text_of[k] for k in x.tolist()]).decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except (TypeError, UnicodeDecodeError):
                out.append(self.whole.decode(x.tolist(), skip_special_tokens=False))
        return out

    def restored(self, text: str) -> str:
        """What decoding must give: the normalised text without the marker."""
        if not text:
            return ""
        plain_ = self.normalized(text).replace(SPACE, " ")
        return plain_[1:] if self.model.dummy_prefix else plain_


@cache
def codec(path: str, threads: int) -> Codec:
    return Codec(path, threads)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most BATCH texts and about BATCH_CHARS characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if len(run) >= BATCH or size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL, threads: int = THREADS, keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_crc32 (of the ids as little-endian int32), parity (ids equal those
    of the sentencepiece library), round_trip (the ids decode to the normalised text), and ids.

    Added columns replace columns of these names.
    """
    added = {"n_tokens": "bigint", "ids_crc32": "bigint", "parity": "boolean", "round_trip": "boolean"} | ({"ids": "array<int>"} if keep_ids else {})
    docs = docs.drop(*added)
    names = docs.columns
    at = names.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for b in batches:
            done = 0
            for run in _batches([t or "" for t in b.column(at).to_pylist()]):
                ids = c.encode(run)
                parity = [np.array_equal(x, y) for x, y in zip(ids, c.reference.encode(run, num_threads=threads), strict=True)]
                trip = [x == c.restored(t) for x, t in zip(c.decode(ids), run, strict=True)]
                more = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(parity, pa.bool_()), pa.array(trip, pa.bool_())]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    more.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(run)).columns, *more], names=[*names, *added])
                done += len(run)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in added.items())])
    return docs.mapInArrow(encode, schema)


def decoded(ids: DataFrame, ids_col: str = "ids", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``ids`` with a column text decoded from an array of ids (null: empty)."""
    rest = [c for c in ids.columns if c != "text"]
    ids = ids.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for b in batches:
            texts = c.decode([np.array(x or [], np.int32) for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*rest, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema), "text string"])
    return ids.mapInArrow(decode, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    return encoded(docs, keep_ids=False).drop("text")
