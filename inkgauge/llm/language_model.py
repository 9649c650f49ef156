"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

The probability of a word is that of its class given the two words before it, times that of the word given its class
and the word before it. Both factors are maximum-entropy models over hashed features. Classes see the word before, the
word before that (a skip), and both together; words see the pair with the word before, hashed into the slots of that
word's row, beside their own frequency. All known words are in classes of equal weight; the others are one class, within
which a word has its smoothed unigram probability, so that the model is a distribution over the whole vocabulary and one
unknown word.

Rows, that is words before that have weights of their own, grow in number with the corpus up to ROWS_MOST; the commonest
words take a row each, the others share the last quarter. All training tokens add up to counts by context and class and
by row and word, which stay distributed in blocks and are summed as streams. Each row's weights follow from its own
counts by gradient steps within its task. For classes every block yields in each round the gradient of its counts; the
driver adds the gradients, whose size is the model's, and sends the new weights. Texts are scored in sparse batches:
a softmax for each different context, three look-ups for each token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, scope, text_or_empty, written

KNOWN = 1 << 17  # words within the softmax, whose counts every task holds; rarer ones are joined
CLASSES = 64  # of known words; class 0 holds the others
ROWS_LEAST, ROWS_MOST, TOKENS_A_ROW = 256, 2048, 1 << 14  # rows of the word before; training tokens for each
SLOTS = 4096  # weights of a row
SECOND, BOTH = 64, 4096  # hash buckets of the word before the one before, and of both
ROUNDS = 10
PENALTY = 8.0  # L2, in counts
LONGEST = 64  # bytes; longer words are known by a digest
FLUSH = 400_000
TOKENS = 1 << 20  # counted or scored together
BLOCK_ROWS, BLOCK_CONTEXTS = 8, 1024
END = b""


def canonical(word: bytes) -> bytes:
    """The word itself, or a blank and a digest of a very long one; words hold no blank."""
    return word if len(word) <= LONGEST else b" " + xxhash.xxh3_128_digest(word) + xxhash.xxh64_digest(word)


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text, held_out; a null id has the remainder of the empty text."""
    key = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(f"`{id_col}`").alias("doc"), text_or_empty(text_col).alias("text"), (key % 10 == 0).alias("held_out"))


def word_counts(src: DataFrame) -> DataFrame:
    """word (binary, canonical; the end is empty), c: counts over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(map(canonical, held), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.encode().lower().split())
                held[END] += 1
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return src.where("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Numbers of the known words by falling count, and what contexts and classes follow from them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, types: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.known = m = len(words)
        self.counts = np.append(counts, 0).astype(np.float64)  # the last: a word that isn't known
        self.rows = int(min(ROWS_MOST, max(ROWS_LEAST, 1 << max(1, tokens // TOKENS_A_ROW).bit_length() - 1)))
        self.word_class = np.zeros(m + 1, np.int64)
        if m:
            mass = np.cumsum(np.sqrt(self.counts[:m]))
            self.word_class[:m] = 1 + np.minimum(CLASSES - 1, ((mass - mass[0] / 2) * CLASSES / mass[-1]).astype(np.int64))
        #: Where classes begin among the known words, which are in class order.
        self.starts = np.flatnonzero(np.diff(self.word_class[:m], prepend=-1))
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words] + [0], np.uint64)
        number = np.arange(m + 1)
        bucket = lambda own, total, seed: np.where(number < own, number, own + ((hashed + np.uint64(seed)) % np.uint64(total - own)).astype(np.int64))
        self.first, self.second = bucket(self.rows * 3 // 4, self.rows, 0), bucket(48, SECOND, 1)
        self.slot = (hashed[:m] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % SLOTS
        #: Tokens and types of the words that aren't known, and what their class weighs.
        self.rest = tokens - float(self.counts.sum()), types - m
        self.rest_weight = self.rest[0] + 0.1 * (self.rest[1] + 1)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and second bucket of each token of texts that begin at starts; before a text stands its end."""
        end = self.number.get(END, self.known)
        before = np.r_[end, ids[:-1]]
        before[starts] = end
        skip = np.r_[end, before[:-1]]
        skip[starts] = end
        return self.first[before], self.second[skip]


class Texts:
    """Words of many texts, gathered until there are enough to be worked on together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ids, self.sizes, self.total = vocabulary, [], [], 0

    def add(self, text: str) -> tuple[list[bytes], np.ndarray]:
        words = text.encode().lower().split()
        words.append(END)
        number, missing = self.vocabulary.number, self.vocabulary.known
        ids = np.fromiter((number.get(w, missing) for w in words), np.int64, len(words))
        self.ids.append(ids)
        self.sizes.append(len(ids))
        self.total += len(ids)
        return words, ids

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where texts begin."""
        ids = np.concatenate(self.ids or [np.zeros(0, np.int64)])
        starts = np.cumsum([0, *self.sizes[:-1]]) if self.sizes else np.zeros(0, np.int64)
        self.ids, self.sizes, self.total = [], [], 0
        return ids, starts


COUNTED = "factor int, block int, at binary, n binary"


def zipped(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint32).tobytes())


def unzipped(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)


def block_size(factor: int, vocabulary: Vocabulary) -> int:
    return BLOCK_ROWS * vocabulary.known if factor else BLOCK_CONTEXTS * (CLASSES + 1)


def counted_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["factor", "block", "at", "n"])


def context_counts(src: DataFrame, vocabulary) -> DataFrame:
    """factor, block, at, n: counts of a block's cells by context and class (factor 0) or by row and word (1), in some parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        held = Texts(v)

        def out() -> Iterator[pa.RecordBatch]:
            ids, starts = held.take()
            first, second = v.contexts(ids, starts)
            inside = ids < v.known
            for factor, cells in enumerate(((first * SECOND + second) * (CLASSES + 1) + v.word_class[ids], first[inside] * v.known + ids[inside])):
                if not len(cells):
                    continue
                cells, n = np.unique(cells, return_counts=True)
                block, at = np.divmod(cells, block_size(factor, v))
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                rows = [(factor, int(block[i]), zipped(np.diff(at[i:j], prepend=0)), zipped(n[i:j])) for i, j in zip(edges, [*edges[1:], len(block)], strict=True)]
                for i in range(0, len(rows), 64):
                    yield counted_rows(rows[i : i + 64])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.add(text)
                if held.total >= TOKENS:
                    yield from out()
        yield from out()

    made = src.where("not held_out").select("text").mapInArrow(run, COUNTED)
    # The first of two steps of sums. Parts come sorted by block, so that a task holds one block at a time.
    salts = F.pmod(F.xxhash64("at", "n"), F.lit(32))
    return written(in_blocks(made.repartition("factor", "block", salts), vocabulary, counted_sum, COUNTED))


def in_blocks(parts: DataFrame, vocabulary, finish: Callable, fields: str) -> DataFrame:
    """What finish makes of each block's sum over the parts of it in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        key, cells = None, None
        for batch in batches:
            for f, b, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (f, b) != key:
                    if key:
                        yield finish(*key, cells, v)
                    key, cells = (f, b), np.zeros(block_size(f, v), np.int64)
                cells[np.cumsum(unzipped(at), dtype=np.int64)] += unzipped(n)
        if key:
            yield finish(*key, cells, v)

    return parts.sortWithinPartitions("factor", "block").mapInArrow(run, fields)


def counted_sum(factor: int, block: int, cells: np.ndarray, vocabulary: Vocabulary) -> pa.RecordBatch:
    at = np.flatnonzero(cells)
    return counted_rows([(factor, block, zipped(np.diff(at, prepend=0)), zipped(cells[at]))])


def row_weights(n: np.ndarray, v: Vocabulary, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a row's slots by gradient steps from the counts of the words after it, and the log normaliser of each class."""
    bias, lengths = np.log(v.counts[: v.known]), np.diff(np.r_[v.starts, v.known])
    w = np.zeros(SLOTS)
    seen = np.repeat(np.add.reduceat(n, v.starts), lengths)
    observed = np.bincount(v.slot, n, SLOTS)
    for step in range(rounds + 1):
        if step == rounds:
            w = w.astype(np.float16).astype(np.float64)
        z = np.exp(bias + w[v.slot])
        total = np.add.reduceat(z, v.starts)
        if step == rounds:
            return w.astype(np.float16), np.log(total)
        expected = np.bincount(v.slot, z * seen / np.repeat(total, lengths), SLOTS)
        w += np.clip((observed - expected - PENALTY * w) / (np.maximum(expected, observed * 0.2) + PENALTY), -2, 2)
    raise AssertionError


def train_rows(counts: DataFrame, vocabulary, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by row and slot, log normalisers by row and class; each row is trained where its counts meet."""
    v: Vocabulary = vocabulary.value
    weights, log_total = np.zeros((v.rows, SLOTS), np.float16), np.zeros((v.rows, CLASSES + 1))
    if not v.known:
        return weights, log_total
    classes = v.word_class[v.starts]
    log_total[:, classes] = np.log(np.add.reduceat(v.counts[: v.known], v.starts))

    def finish(factor: int, block: int, cells: np.ndarray, own: Vocabulary) -> pa.RecordBatch:
        rows = [(block * BLOCK_ROWS + r, *row_weights(n, own, rounds)) for r, n in enumerate(cells.reshape(BLOCK_ROWS, -1).astype(np.float64)) if n.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["row", "weights", "log_total"])

    made = in_blocks(counts.where("factor = 1").repartition("block"), vocabulary, finish, "row int, weights binary, log_total binary").toArrow()
    for r, w, z in zip(*(made[c].to_pylist() for c in ("row", "weights", "log_total")), strict=True):
        weights[r], log_total[r, classes] = np.frombuffer(w, np.float16), np.frombuffer(z)
    return weights, log_total


def class_features(context: np.ndarray) -> list[np.ndarray]:
    """Rows of the three class weight tables for each context."""
    a, b = context // SECOND, context % SECOND
    return [a, b, (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) % BOTH]


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Classes by their weight alone; those without words have none."""
    bias = np.full(CLASSES + 1, -60.0)
    bias[0] = math.log(v.rest_weight)
    if v.known:
        bias[v.word_class[v.starts]] = np.log(np.add.reduceat(v.counts[: v.known], v.starts))
    return {"bias": bias - bias.max(), **{k: np.zeros((n, CLASSES + 1)) for k, n in (("first", v.rows), ("second", SECOND), ("both", BOTH))}}


def softmax_of_classes(w: dict, context: np.ndarray) -> np.ndarray:
    a, b, c = class_features(context)
    z = w["bias"] + w["first"][a] + w["second"][b] + w["both"][c]
    z -= z.max(1, keepdims=True)
    np.exp(z, z)
    return z / z.sum(1, keepdims=True)


def block_gradient(block: int, cells: np.ndarray, w: dict) -> dict[str, tuple]:
    """Observed and expected counts of each weight that a block touches."""
    n = cells.reshape(-1, CLASSES + 1).astype(np.float64)
    context = np.arange(len(n)) + block * BLOCK_CONTEXTS
    used = n.sum(1) > 0
    n, context = n[used], context[used]
    expected = softmax_of_classes(w, context) * n.sum(1, keepdims=True)
    out = {"bias": (n.sum(0), expected.sum(0))}
    for name, row in zip(("first", "second", "both"), class_features(context), strict=True):
        o, e = np.zeros_like(w[name]), np.zeros_like(w[name])
        np.add.at(o, row, n)
        np.add.at(e, row, expected)
        out[name] = o, e
    return out


def train_classes(counts: DataFrame, vocabulary, rounds: int) -> dict[str, np.ndarray]:
    """Weights after rounds of distributed gradient steps, each scaled by the expected count of its weight."""
    v: Vocabulary = vocabulary.value
    w = start_weights(v)
    context = counts.sparkSession.sparkContext
    if not v.known or not rounds:
        return w
    blocks = -(-v.rows * SECOND // BLOCK_CONTEXTS)
    parts = written(in_blocks(counts.where("factor = 0").repartition("block"), vocabulary, counted_sum, COUNTED))
    # as many gradients as tasks read the table, whose size is bounded
    parts = parts.coalesce(max(1, blocks // 16))
    observed: dict[str, np.ndarray] = {}
    for step in range(rounds):
        shared = context.broadcast({k: x.astype(np.float32) for k, x in w.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for block, at, n in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                    cells = np.zeros(BLOCK_CONTEXTS * (CLASSES + 1), np.int64)
                    cells[np.cumsum(unzipped(at), dtype=np.int64)] = unzipped(n)
                    for name, (o, e) in block_gradient(block, cells, shared.value).items():
                        for key, x in ((f"e {name}", e), *([(f"o {name}", o)] if step == 0 else [])):
                            total[key] = total[key] + x if key in total else x
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["name", "part"])

        made = parts.mapInArrow(run, "name string, part binary").groupBy("name").applyInArrow(add_parts, "name string, part binary").toArrow().to_pylist()
        sums = {r["name"]: np.frombuffer(r["part"], np.float32).astype(np.float64).reshape(w[r["name"][2:]].shape) for r in made}
        observed |= {k[2:]: x for k, x in sums.items() if k[0] == "o"}
        for name, o in observed.items():
            e = sums[f"e {name}"]
            w[name] = w[name] + np.clip((o - e - PENALTY * w[name] * (name != "bias")) / (np.maximum(e, o * 0.2) + PENALTY), -2, 2) / 2
        shared.unpersist()
    return w


def add_parts(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float32) for x in table["part"].to_pylist()], 0, np.float64)
    return pa.table({"name": table["name"][:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


class Model:
    """log10 probabilities of tokens."""

    def __init__(self, v: Vocabulary, classes: dict[str, np.ndarray], rows: tuple[np.ndarray, np.ndarray]):
        self.classes = {k: x.astype(np.float32) for k, x in classes.items()}
        self.weights, self.log_total = rows[0], rows[1].astype(np.float32)
        self.bias = np.log(np.maximum(v.counts, 1)).astype(np.float32)

    def log_shares(self, v: Vocabulary, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each token in its context; of a word that isn't known, that of their class."""
        context, inverse = np.unique(first * SECOND + second, return_inverse=True)
        out, cls = np.zeros(len(ids)), v.word_class[ids]
        order = np.argsort(inverse, kind="stable")
        edges = np.searchsorted(inverse[order], np.arange(0, len(context) + 8192, 8192))
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            at = order[i:j]
            p = softmax_of_classes(self.classes, context[k * 8192 : (k + 1) * 8192])
            out[at] = np.log(p[inverse[at] - k * 8192, cls[at]])
        known = np.flatnonzero(ids < v.known)
        a, w = first[known], ids[known]
        out[known] += self.bias[w] + self.weights[a, v.slot[w]].astype(np.float64) - self.log_total[a, cls[known]]
        return out / math.log(10)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """A row for each document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text and its end. Training uses all documents but the held-out tenth;
    counts cover all their tokens. Null texts count as empty and are one end token. Ids may be null or repeat, each
    row is scored by itself; other columns are ignored; an empty table gives no rows. Without training documents every
    token is unknown and has probability 1.
    """
    with scope(docs.sparkSession):
        return lasting(_score_documents(docs, id_col, text_col, rounds, known))


def fit(src: DataFrame, counts: DataFrame, rounds: int, known: int):
    """Vocabulary and model, both broadcast; counts is the written table of word_counts."""
    spark = src.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(known).toArrow()
    own = Vocabulary(top["word"].to_pylist(), top["c"].to_numpy() if len(top) else np.zeros(0, np.int64), n, v)
    vocabulary = spark.sparkContext.broadcast(own)
    parts = context_counts(src, vocabulary)
    return vocabulary, spark.sparkContext.broadcast(Model(own, train_classes(parts, vocabulary, rounds), train_rows(parts, vocabulary, rounds))), n, v


def _score_documents(docs: DataFrame, id_col: str, text_col: str, rounds: int, known: int) -> DataFrame:
    src = source(docs, id_col, text_col)
    counts = written(word_counts(src))
    vocabulary, model, n, v = fit(src, counts, rounds, known)
    base_total, rest_total = math.log10(n + 0.1 * (v + 1)), math.log10(vocabulary.value.rest_weight)
    kind = src.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = vocabulary.value
        logs = np.log10(vocab.counts + 0.1)
        held = Texts(vocab)

        def scored() -> Iterator[tuple[int, int, float, float]]:
            ids, starts = held.take()
            if not len(ids):
                return
            here = ids < vocab.known
            share = model.value.log_shares(vocab, *vocab.contexts(ids, starts), ids) - np.where(here, 0.0, rest_total)
            sums = [np.add.reduceat(x, starts).tolist() for x in (here.astype(np.int64), np.where(here, logs[ids], 0.0), share)]
            yield from zip(np.diff(np.r_[starts, len(ids)]).tolist(), *sums, strict=True)

        for batch in batches:
            if not batch.num_rows:
                continue
            done: list[tuple[int, int, float, float]] = []
            rare, times = [], []
            for text in batch.column(1).to_pylist():
                words, ids = held.add(text)
                others = Counter(canonical(words[i]) for i in np.flatnonzero(ids == vocab.known).tolist())
                rare.append([*others])
                times.append([*others.values()])
                if held.total >= TOKENS // 4:
                    done.extend(scored())
            done.extend(scored())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["doc", "held_out", "n_tokens", "n_here", "base_here", "score_here", "rare", "times"],
            )

    scored = src.select("doc", "text", "held_out").mapInArrow(run, f"doc {kind}, held_out boolean, n_tokens long, n_here long, base_here double, score_here double, rare array<binary>, times array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    # Rare words are joined with their counts and summed by document; a document without any has no row there.
    words = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    found = words.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))).alias("log_rare"))
    done = scored.drop("rare", "times").join(found, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return done.select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", (F.col("n_here") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_here") + log_rare - F.col("n_tokens") * F.lit(base_total)).alias("base_score"), (F.col("score_here") + log_rare).alias("score"),
    )
