"""Best-fit packing of tokenised documents into sequences, certified by lower bounds and repacked where a gap remains.

Pieces are dealt into partitions of bounded size, each packed by best-fit decreasing. Dual-feasible functions bound
from below how many sequences a partition's pieces need. Where the packing meets the bound, it is certified. The
partitions with a gap give the documents of their sequences that aren't full into common partitions, which are packed
again by best-fit decreasing; the exchange stands if it saves sequences, and is tried again until it saves none.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, scope, text_or_empty, trimmed, written

CACHE = 80_000  # words of a generation that a worker remembers; it keeps two
STEMS = 150_000  # and stems of a generation, which cost more to find again
LONG_TEXT = 8 << 20
END = (1).to_bytes(4, "little")
# Printable ASCII, and Latin and Cyrillic letters that are composed, lower-case one by one and stay letters.
PLAIN = re.compile("(?!.*<\\|)[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u04ff]*").fullmatch
# Bytes without a printable Latin-1 character, which byte-level models write as letters from 256 on.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
LETTERS = "".join(chr(BYTE_LETTERS.get(b, b)) for b in range(256))


#: What a tokenizer file must say of itself for the quick way by words: fixed values.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class TextEncoder:
    """Ids of a text by any tokenizer, as little-endian 32-bit words."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class WordEncoder:
    """Ids of a text as little-endian 32-bit words, for a tokenizer that drops white space.

    Such a tokenizer treats each run between white space by itself, so runs are encoded once and looked up afterwards.
    Only ASCII white space parts runs here; other kinds stay inside a run, which goes to the tokenizer as it is.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.stem_ids = self.tokenizer.model.tokenize
        self.within = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^!-`{-~]+|[0-9]|[!-/:-@\\[-`{-~]+")
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before; a word that is met again moves up
        self.stems: dict[str, bytes] = {}
        self.older_stems: dict[str, bytes] = {}

    def _stem(self, stem: str) -> bytes:
        """Ids of one run of letters, digit or run of marks, in the model's letters for bytes."""
        if not stem.isascii():
            stem = codecs.charmap_decode(stem.encode(), "strict", LETTERS)[0]
        return array("I", [t.id for t in self.stem_ids(stem)]).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Ids of words that aren't known yet: plain ones by their stems and marks, the others in one call."""
        known, stems, within = self.words, self.stems, self.within.findall
        texts = b" ".join(words).decode().split(" ")
        if not PLAIN(" ".join(texts)):
            whole = [t for t in texts if not PLAIN(t)]
            texts = [t for t in texts if PLAIN(t)]
            made = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
            known.update((t.encode(), array("I", e.ids).tobytes()) for t, e in zip(whole, made, strict=True))
        joined = " ".join(texts)
        plain, lows = joined.encode().split(), joined.lower().split()
        parted = {low: within(low) for low in {*lows}.difference(stems)}
        lacking = {*chain.from_iterable(parted.values())}.difference(stems)
        older = self.older_stems
        for p in older.keys() & lacking:
            stems[p] = older[p]
        for p in lacking.difference(stems):
            stems[p] = self._stem(p)
        found = {low: stems[ps[0]] if len(ps) == 1 else b"".join([stems[p] for p in ps]) for low, ps in parted.items()}
        known.update((w, stems[low] if low in stems else found[low]) for w, low in zip(plain, lows, strict=True))

    def encode(self, text: str) -> bytes:
        words = text.encode().split()
        distinct = {*words}
        new = distinct.difference(self.words)
        if len(self.words) + len(new) > CACHE:
            self.older, self.words = self.words, {}
            new = distinct
        if len(self.stems) > STEMS:
            self.older_stems, self.stems = self.stems, {}
        if self.older and new:
            again = self.older.keys() & new
            self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        if new:
            self._learn(new)
        ids = b"".join(map(self.words.__getitem__, words))
        if len(new) > CACHE or len(text) > LONG_TEXT:  # a text whose own words would crowd out all others
            self.words, self.older, self.stems, self.older_stems = {}, {}, {}, {}
        return ids


@functools.lru_cache(maxsize=2)
def _encoder(key: str, model: str) -> WordEncoder | TextEncoder:
    known = json.loads(model)
    return WordEncoder(model) if all(known.get(k) == v for k, v in BY_WORDS.items()) else TextEncoder(model)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 (and ids, binary) of each piece; every document ends with id 1."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError(f"{tokenizer_path}: a vocabulary of over 64 MB isn't broadcast")
    model = docs.sparkSession.sparkContext.broadcast(text)
    src = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("__text"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(hashlib.sha256(model.value.encode()).hexdigest(), model.value)
        for batch in batches:
            take, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    take.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if keep_ids:
                        kept.append(cut)
            out = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary())] if keep_ids else [])], [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return src.mapInArrow(lambda batches: trimmed(run(batches)), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: each item, longest first, into the fullest bin that holds it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # of open bins, ascending, each once
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            held = open_bins[room]
            bin_ = held.pop()
            if not held:
                del open_bins[room], rooms[at]
        else:
            room, bin_, n = capacity, n, n + 1
        bins[i], offsets[i] = bin_, capacity - room
        if left := room - need:
            if left not in open_bins:
                open_bins[left] = []
                bisect.insort(rooms, left)
            open_bins[left].append(bin_)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds by two families of dual-feasible functions.

    For a limit e up to half the capacity: items over capacity - e count whole, those under e nothing. For k from 1 on:
    an item counts floor((k + 1) x) / k of its share x, or x where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    items, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(capacity // 2 + 1)
    over = items[-1] - items[capacity - e + 1]
    bound = int((over + -(-(mass[capacity - e + 1] - mass[e]) // capacity)).max())
    for k in range(1, 41):
        whole, rest = np.divmod((k + 1) * size, capacity)
        share = np.where(rest == 0, k * size, whole * capacity)  # in units of 1 / (k capacity)
        bound = max(bound, -(-int((count * share).sum()) // (k * capacity)))
    return bound


def _packed(rows: DataFrame, partitions: int, capacity: int, turn: int) -> DataFrame:
    """rows with __part, __bin, offset, __room (free in the bin) and __gap (its partition isn't certified)."""
    rows = rows.drop("__part", "__bin", "offset", "__room", "__gap").withColumn("__part", F.pmod(F.xxhash64("__uid", F.lit(turn)), F.lit(partitions)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        room = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        gap = n > lower_bound(lengths, capacity)
        for name, x in (("__bin", pa.array(bins)), ("offset", pa.array(offsets)), ("__room", pa.array(room[bins])), ("__gap", pa.array([gap] * len(bins), pa.bool_()))):
            table = table.append_column(name, x)
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return written(rows.groupBy("__part").applyInArrow(pack, f"{fields}, __bin long, offset long, __room long, __gap boolean"))


def _bins(rows: DataFrame) -> int:
    return rows.where(F.col("offset") == 0).count()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 4096, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, certified (and ids on request).

    certified says that the piece's sequence belongs to a partition that takes no more sequences than its lower bound.

    tokenizer_path names any file of the tokenizers library; one whose rules are BY_WORDS is encoded by words, faster.
    A document's tokens and its end token are cut only where they exceed capacity. Null texts count as empty and are
    one end token. Ids may be null, tie or repeat; each row is a document of its own; other columns are ignored; an
    empty table gives no rows. Pieces are dealt by row, not by id, so that no key can fill a partition.
    """
    with scope(docs.sparkSession):
        return lasting(_pack_documents(docs, tokenizer_path, capacity, id_col, text_col, part_rows, keep_ids))


def _pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, part_rows: int, keep_ids: bool) -> DataFrame:
    pieces = written(token_pieces(docs, tokenizer_path, capacity, id_col, text_col, keep_ids).withColumn("__uid", F.monotonically_increasing_id()))
    narrow = pieces.drop("ids")
    whole = narrow.where(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("offset"), (F.col("__uid") * 2).alias("sequence_id"), F.lit(True).alias("certified"))
    rest = narrow.where(F.col("length") < capacity)
    name = lambda df, base: df.select(*narrow.columns, "offset", (((F.lit(base).cast("long") + F.col("__part")) * (1 << 24) + F.col("__bin")) * 2 + 1).alias("sequence_id"), (~F.col("__gap")).alias("certified"))
    base = max(1, math.ceil(rest.count() / part_rows))
    now, done, turn, first = _packed(rest, base, capacity, 0), [whole], 0, 0
    while True:
        moving = now.where(F.col("__gap") & (F.col("__room") > 0))
        n, old = moving.count(), _bins(moving)
        if old < 2:
            break
        partitions, turn = max(1, math.ceil(n / part_rows)), turn + 1
        again = _packed(moving, partitions, capacity, turn)
        if _bins(again) >= old:
            break
        done.append(name(now.where(~(F.col("__gap") & (F.col("__room") > 0))), first))
        now, first, base = again, base, base + partitions
    done.append(name(now, first))
    out = functools.reduce(DataFrame.unionByName, done)
    if keep_ids:
        out = out.join(pieces.select("__uid", "ids"), "__uid")
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", *(["ids"] if keep_ids else []))
