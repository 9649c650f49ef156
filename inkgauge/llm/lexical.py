"""Ranked lexical search: postings in term buckets, joined with the terms of items, scored in integers and summed by document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, scope, text_or_empty, trimmed, written

#: Bytes that end a term become blanks, A-Z become a-z; bytes from 0x80 on are parts of terms.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BLOCK = 1 << 11  # documents whose postings lie together
BUCKETS = 64  # of terms
VOCABULARY_BYTES = 1 << 26  # of the items' terms, up to which every task knows them


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII of a text in UTF-8, A-Z in lower case."""
    return raw.translate(FOLD).split()


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (number of the row), item_id, term, times. Every row is an item of its own; a null text has no terms."""
    src = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(number, i, t, n) for t, n in Counter(terms_of(raw)).items()]
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["item", "item_id", "term", "times"])

    return src.mapInArrow(run, "item long, item_id long, term binary, times long")


def postings(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, bucket, term, doc_ids, places, tfs, lengths: for each block of documents and term those that hold it; and a row without
    term for each block, whose lists hold its number of documents with terms (tfs) and of their terms (lengths).

    With a vocabulary only its terms have postings; the rows without term count all. A posting list is cut at blocks, so
    a term of all documents makes no row longer than a block.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        block, place, lists, n_docs, n_terms = TaskContext.get().partitionId() << 32, 0, {}, 0, 0

        def out() -> pa.RecordBatch:
            rows = [None, *lists]
            held = [([], [], [n_docs], [n_terms]), *lists.values()]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary()), *[pa.array([h[k] for h in held], pa.list_(pa.int64())) for k in range(4)]], ["block", "term", "doc_ids", "places", "tfs", "lengths"])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(raw)
                if terms:
                    n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                    for t, tf in Counter(terms if wanted is None else filter(wanted.__contains__, terms)).items():
                        here = lists.get(t) or lists.setdefault(t, ([], [], [], []))
                        for xs, x in zip(here, (i, place, tf, len(terms)), strict=True):
                            xs.append(x)
                place += 1
                if place == BLOCK:
                    yield out()
                    block, place, lists, n_docs, n_terms = block + 1, 0, {}, 0, 0
        if place:
            yield out()

    fields = ", ".join(f"{c} array<long>" for c in ("doc_ids", "places", "tfs", "lengths"))
    return src.mapInArrow(lambda batches: trimmed(run(batches)), f"block long, term binary, {fields}").withColumn("bucket", bucket_of(F.col("term")))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with score above 0 of each item; equal scores by id.

    items have item_id and text. Scores are as the contract of the query says: integers, from a term's weight by its number of
    documents and from its occurrences in a text of that length. Every row of docs is a document and every row of items an
    item of its own, whatever ids they have; null ids stay null and come first among equal scores; null and empty texts
    have no terms. Other columns are ignored; no documents or no items give no rows.

    Postings are dealt by blocks of documents and lie in buckets of terms within them, so that after the join with the
    items' terms all matches of a document are in one task: sums need no further shuffle. Only the k best of
    each task and item go on.
    """
    with scope(docs.sparkSession):
        return lasting(_ranked(docs, items, k, id_col, text_col))


def _ranked(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    wanted = written(item_terms(items))
    distinct = wanted.select("term").distinct()
    few = _bytes(distinct) <= VOCABULARY_BYTES
    vocabulary = frozenset(chain.from_iterable(b.to_pylist() for b in distinct.toArrow().column("term").chunks)) if few else None
    index = written(postings(docs, vocabulary, id_col, text_col).sortWithinPartitions("bucket", "term", "block"))
    lists = index.where("term is not null")
    n, length = index.where("term is null").agg(F.coalesce(F.sum(F.get("tfs", F.lit(0))), F.lit(0)), F.coalesce(F.sum(F.get("lengths", F.lit(0))), F.lit(0))).first()

    df = lists.groupBy("term").agg(F.sum(F.size("doc_ids").cast("long")).alias("df"))
    weight = F.expr(f"cast(floor(1000 * ln(cast(2 * {n}L + 2 as double) / cast(2 * df + 1 as double))) as long)")
    weighed = written(wanted.join(df, "term").select(bucket_of(F.col("term")).alias("bucket"), "term", "item", "item_id", (F.col("times") * weight).alias("w")).where("w > 0"))
    if _bytes(weighed) <= VOCABULARY_BYTES:
        matches = lists.repartition("block").join(F.broadcast(weighed), ["bucket", "term"])
    else:
        matches = lists.join(weighed, ["bucket", "term"]).repartition("block")
    each = matches.select("block", "item", "item_id", "w", F.inline(F.arrays_zip("doc_ids", "places", "tfs", "lengths")))
    score = F.expr(f"w * ((1000000000 * tfs) div (1000 * tfs + 12 * (75 + (25 * lengths * {n}L) div {max(1, length)}L)))")
    scored = each.select("block", "item", "item_id", "places", F.col("doc_ids").alias("doc_id"), score.alias("score"))
    summed = scored.groupBy("block", "item", "item_id", "places", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "block", "places")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").alias(id_col), "score")


def _bytes(terms: DataFrame) -> int:
    """About what the rows take in a task's memory."""
    return terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
