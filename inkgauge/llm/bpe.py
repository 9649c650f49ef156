"""Byte-level BPE through a sentencepiece model that is serialised from the rank file itself.

Every vocabulary entry becomes a piece: each of its bytes is written as one printable character, its score is
minus its rank, so that sentencepiece merges in rank order. Normalisation is the identity. A pre-token (one match
of the pattern) that is itself an entry takes that rank at once, as rank-file libraries do; others go to the model.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: White_Space of Unicode, as the rank-file libraries' engine reads \s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Chunks that a worker remembers; two generations of this size at most.
CACHE = 400_000
LONGEST_CACHED = 96


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else one from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the entry, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE; piece i + 1 is the entry with the i-th lowest rank, piece 0 unknown."""
    names = byte_characters()
    order = sorted(ranks, key=ranks.get)
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(names[b] for b in e).encode()) + _field(2, -float(ranks[e])) + _field(3, 1) for e in order]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class _Cache(dict):
    """Strings to what a function makes of them; when a generation is full, the one before it goes."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.old.get(key)) is None:
            ids = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class ByteBpe:
    """Encoder and decoder; built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.ranks = ranks
        order = sorted(ranks, key=ranks.get)
        self.of_piece = [0, *(ranks[e] for e in order)]
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.to_text = {b: c for b, c in enumerate(byte_characters())}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.rare = re.compile(f"[{SPACE}]".replace(r"\t-\r ", r"\t\x0b-\r"))
        size = max(ranks.values(), default=-1) + 1
        self.entries: list[bytes] = [b""] * size
        for e, r in ranks.items():
            self.entries[r] = e
        self.digits = [str(i) for i in range(size)]
        self.lengths = np.array([len(e) for e in self.entries], np.int64)
        self.pretokens = _Cache(self.encode_pretoken)
        self.parts = _Cache(lambda part: self.encode_chunk(part if part[:1] == "\n" else " " + part))

    def encode_pretoken(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of one match of the pattern."""
        raw = piece.encode()
        if (rank := self.ranks.get(raw)) is not None:
            return rank.to_bytes(4, "little")
        ids = self.sp.encode(raw.decode("latin-1").translate(self.to_text))
        return struct.pack(f"<{len(ids)}I", *map(self.of_piece.__getitem__, ids))

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.split.findall(chunk)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.

        Where each space or line end stands alone between other characters and no other white space occurs, no
        pre-token crosses the place before it, so the parts between them are looked up; any other text is split by
        the pattern as a whole.
        """
        if not text:
            return np.zeros(0, "<u4")
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or self.rare.search(text):
            return np.frombuffer(self.encode_chunk(text), "<u4")
        return np.frombuffer(self.encode_chunk(parts[0]) + b"".join(map(self.parts.__getitem__, parts[1:])), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(ranks_key: str, model: bytes, pattern: str) -> ByteBpe:
    names = {c: b for b, c in enumerate(byte_characters())}
    return ByteBpe(_ranks_of(model, names), model, pattern)


def _ranks_of(model: bytes, names: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary back out of the serialised model: score and spelling hold all of it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return {bytes(names[c] for c in sp.id_to_piece(i)): int(-sp.get_score(i)) for i in range(1, sp.get_piece_size())}


def worker_codec(model: bytes, pattern: str) -> ByteBpe:
    """The codec of this Python worker; it outlives a task."""
    return _codec(hashlib.sha256(model).hexdigest(), model, pattern)


def shared_model(df: DataFrame, ranks_path: str):
    """The serialised model as a broadcast; a vocabulary file is bounded, which is checked here."""
    model = serialise_model(read_ranks(ranks_path))
    if len(model) > 64 << 20:
        raise ValueError(f"{ranks_path}: a vocabulary of over 64 MB isn't broadcast")
    return df.sparkSession.sparkContext.broadcast(model)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return a row for each document.

    Columns: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes), and on request token_ids (array of int) and decoded (binary). A null text counts as empty: no tokens,
    digests of nothing. Ids may be null or repeat; each row stands alone. Other columns are ignored, whatever their
    names. An empty table gives no rows. A map over rows: no shuffle, and skew of keys doesn't matter.
    """
    model = shared_model(docs, ranks_path)
    src = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("__text"))
    fields = f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids + ", decoded binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(raw := codec.decode(ids)).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                if keep_text:
                    all_text.append(raw)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out, names = [*out, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "token_ids"]
            if keep_text:
                out, names = [*out, pa.array(all_text, pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return src.mapInArrow(run, fields)
