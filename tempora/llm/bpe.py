"""Byte-level BPE encoding and decoding through sentencepiece.

The rank file's byte strings are spelled in 256 printable characters, one per
byte, and written as a sentencepiece BPE model without any training: a piece's
score is its negative rank, so the library merges the pair of lowest rank first,
and the normaliser is the identity. Texts are split by the tokenizer's pattern
and each pre-token is encoded separately; decoding maps ids back to byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Entries of a task's memory of pre-tokens; the older generation is forgotten as a whole, and all of it with the task.
CACHE = 400_000


def byte_chars() -> str:
    """One printable character for each byte value: itself where it is visible, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0x100
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return "".join(out[b] for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in order of rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} aren't 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protocol-buffer field: int as varint, float as 32 bits, others by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id r is the vocabulary's rank r; the unknown piece comes last."""
    table, n = byte_chars(), len(vocabulary)
    pieces = [_field(1, _field(1, "".join(table[b] for b in t)) + _field(2, float(-r)) + _field(3, 1)) for r, t in enumerate(vocabulary)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes texts; ids travel as decimal strings joined by spaces."""

    #: Spaces next to other white space: such a text isn't cut at its spaces.
    RAGGED = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, vocabulary: list[bytes], pattern: str, proto: bytes | None = None) -> None:
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto or model_proto(vocabulary))
        self.chars = {i: c for i, c in enumerate(byte_chars())}
        self.bytes_of = {str(i): t for i, t in enumerate(vocabulary)}
        self.parts, self.older = {}, {}
        self.tokens: dict[str, str] = {}

    def _learn(self, parts: list[str]) -> None:
        """Fill self.parts for these; pre-tokens that aren't known go to the library together."""
        if len(self.parts) > CACHE:
            self.older, self.parts = self.parts, {}
        known, found = self.parts, self.tokens
        fresh = []
        for p in parts:
            if (ids := self.older.get(p)) is not None:
                known[p] = ids
            else:
                fresh.append((p, self.split(p)))
        if len(found) > CACHE:
            found.clear()
        if missing := list({t for _, ts in fresh for t in ts if t not in found}):
            spelled = [t.encode().decode("latin-1").translate(self.chars) for t in missing]
            for t, ids in zip(missing, self.sp.encode(spelled, num_threads=1), strict=True):
                found[t] = " ".join(map(str, ids))
        for p, ts in fresh:
            known[p] = found[ts[0]] if len(ts) == 1 else " ".join([found[t] for t in ts])

    def encode(self, text: str) -> str:
        """A space between two visible characters always begins a pre-token, so what
        follows it up to the next one is encoded apart and remembered."""
        if not text:
            return ""
        if self.RAGGED.search(text):
            parts = self.split(text)
        else:
            head, *tail = text.split(" ")
            parts = [head, *[" " + t for t in tail]]
        known = self.parts
        if missing := [p for p in set(parts) if p not in known]:
            self._learn(missing)
            if known is not self.parts:  # begun anew meanwhile
                known = self.parts
                self._learn([p for p in set(parts) if p not in known])
        return " ".join(map(known.__getitem__, parts))

    def forget(self) -> None:
        self.parts, self.older, self.tokens = {}, {}, {}

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[int, Codec] = {}


def _codec(vocabulary: list[bytes], pattern: str, proto: bytes) -> Codec:
    """A worker's codec; it outlives a task."""
    if (key := hash((pattern, proto))) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, pattern, proto)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok of every row; with full, also ids (array) and decoded (binary).

    A null or empty text has no tokens, and the digests of nothing. Repeated rows
    and null ids are kept as they are; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, pattern, model_proto(vocabulary)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean" + ", ids array<int>, decoded binary" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = {k: [] for k in ("n", "i", "d", "ok", "ids", "raw")}
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    raw = codec.decode(ids)
                    out["n"].append(ids.count(" ") + 1 if ids else 0)
                    out["i"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["d"].append(hashlib.sha256(raw).hexdigest())
                    out["ok"].append(raw == (text or "").encode())
                    if full:
                        out["ids"].append([int(x) for x in ids.split()])
                        out["raw"].append(raw)
                cols = [part.column(0), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string()), pa.array(out["ok"], pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_ok"]
                if full:
                    cols += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["raw"], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        codec.forget()
        C.trim()

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def default_vocabulary(path: str | None = None) -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_vocabulary())
