"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here: pieces with scores and types, the trainer's
model type and byte fallback, the normaliser's character map and white-space
flags.  From them a tokenizer is rebuilt: normaliser, metaspace marker, unigram
scores (or, for a model of BPE type, merges ranked by the same scores), byte
fallback and the decoder.  Batches are encoded by the library's threads, and
``parity`` compares ids and decoded texts with the sentencepiece library.

Control, unknown and byte pieces, and unused ones of unigram models, never match text;
models with user-defined pieces are refused.  If no piece holds the marker after another character, merges never cross a word
start, and texts are cut there first; the library then caches whole words.

At scale: one narrow pass; the model's bytes (checked: at most ``MODEL_BYTES``) are
what is broadcast, so executors need no files.

Edge cases: a null text has null ids; an empty one none; texts of any length are
encoded whole; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch

MODEL = os.environ.get("CADENZA_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MODEL_BYTES = 64 << 20
THREADS = 2
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: ints, floats as 4 bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, data[at : at + n]
            at += n
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {wire} is not used by these models")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_marker: bool = False


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    if v not in (1, 2):
                        raise ValueError("only unigram and BPE models are supported")
                    m.unigram = v == 1
                elif n == 24:
                    m.suffix_marker = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.suffix_marker or not m.escape:
        raise ValueError("models with a suffix marker or without escaped white space are not supported")
    if any(kind == USER or kind == UNUSED and not m.unigram for _, _, kind in m.pieces):
        raise ValueError("user-defined pieces, and unused ones in BPE models, are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first; of equal ones by the parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in m.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                a, b = ids.get(piece[:i]), ids.get(piece[i:])
                if a is not None and b is not None:
                    found.append((-score, a, b, piece[:i], piece[i:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(data: bytes):
    """The tokenizer of a model file's bytes."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    unk = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    if m.unigram:
        # normalised texts hold no blank, so a name with one matches nothing; the scores of such pieces must not be the least
        low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        model = models.Unigram([(p, s) if kind == NORMAL else (f" {p}", low) for p, s, kind in m.pieces], unk_id=unk, byte_fallback=False)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    hidden = [decoders.Replace(f" {p}", {CONTROL: "", UNKNOWN: " \u2047 "}.get(kind, p)) for p, _, kind in m.pieces if kind != NORMAL] if m.unigram else []
    decode = [*hidden, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*decode, decoders.Strip(" ", 1, 0)] if m.dummy_prefix else decode)
    return tok


@lru_cache(maxsize=2)
def _tokenizer(data: bytes, threads: int):
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return build(data)


@lru_cache(maxsize=2)
def _byte_ids(data: bytes) -> tuple[int, list[int]] | None:
    """The unknown piece and the pieces of all bytes of a unigram model with byte fallback."""
    m = parse(data)
    at = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
    names = [f"<0x{b:02X}>" for b in range(256)]
    if not m.unigram or not m.byte_fallback or not all(n in at for n in names):
        return None
    return next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), [at[n] for n in names]


def encode_ids(texts: list[str], data: bytes, threads: int = THREADS) -> list[list[int]]:
    """Ids of a batch by the library's threads; in unigram models what no piece covers becomes its bytes."""
    tok, fallback = _tokenizer(data, threads), _byte_ids(data)
    if fallback is None:
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    unk, of = fallback
    return [[j for i, t in zip(e.ids, e.tokens, strict=True) for j in ([of[x] for x in t.encode()] if i == unk else [i])] if unk in e.ids else e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def load(path: str = MODEL) -> bytes:
    if not Path(path).is_file():
        raise FileNotFoundError(f"no SentencePiece model at {path}; name one by the argument or CADENZA_SENTENCEPIECE_MODEL")
    data = Path(path).read_bytes()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"a model of {len(data)} bytes is not broadcast; the limit is {MODEL_BYTES}")
    return data


def parity(texts: list[str], data: bytes) -> list[int]:
    """Indices of texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    ref, tok = sentencepiece.SentencePieceProcessor(model_proto=data), build(data)
    ids = encode_ids(texts, data)
    want = ref.encode(texts, num_threads=1)
    back = tok.decode_batch(ids, skip_special_tokens=False)
    return [i for i in range(len(texts)) if ids[i] != want[i] or back[i] != ref.decode(want[i])]


def encode(docs: DataFrame, data: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (the ids decode to the text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(b: pa.RecordBatch):
        tok = _tokenizer(shared.value, threads)
        for t in bk.slices(b.column(1), 1 << 19):
            texts = b.column(1).slice(t.lo, len(t)).to_pylist()
            ids = encode_ids([x or "" for x in texts], shared.value, threads)
            back = tok.decode_batch(ids, skip_special_tokens=False)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)])
            rows = bk.lists(flat, size)
            if None in texts:
                rows = pa.array([None if x is None else y for x, y in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
            yield batch(["doc_id", "ids", "n_tokens", "round_trip"], [b.column(0).slice(t.lo, len(t)), rows, size, pa.array([x is None or x == y for x, y in zip(texts, back, strict=True)])])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return arrow_map(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(rows: DataFrame, data: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(b: pa.RecordBatch):
        ids = b.column(1).to_pylist()
        text = _tokenizer(shared.value, threads).decode_batch([x or [] for x in ids], skip_special_tokens=False)
        yield batch(["doc_id", "text"], [b.column(0), pa.array([None if x is None else y for x, y in zip(ids, text, strict=True)], pa.string())])

    return arrow_map(rows.select("doc_id", "ids"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
