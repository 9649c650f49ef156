"""Stages of the corpus pipeline, and the whole of it, against plain Python; rows whose ids repeat or lack."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkgauge.llm import toxicity
from test_llm import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copies, secrets, nulls and a clashing column, and labels of some."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [(*r, len(r.text or ""), "own") for r in docs]
    text = rows[5][1]
    rows += [(5000, text, "en", "x", len(text), "own"), (5001, text + " tail", "en", "y", 0, None), (5001, "another text under one id", None, None, None, None)]
    rows += [(5002, None, "en", "x", None, "own"), (5003, "", "en", "x", 0, "own"), (None, "a text without id", "en", "x", 3, "own"), (None, text, "en", "x", 3, "own")]
    rows += [(5004, "key 9f86d081884c7d659a2feaa0c55ad015 of one owner and no other", "en", "x", 3, "own")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string").write.parquet(f"file://{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def by_hand_near_copies(rows):
    least = {k: c for k, (_, c) in brute([(k, r[1]) for k, r in enumerate(rows)]).items()}
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[least[k]].append((r[0] is None, r[0] or 0, k))
    return Counter(rows[min(g)[2]] for g in groups.values()) if rows else Counter()


def test_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = rows_of(docs)
    # toxicity: whole rows, and the rejected ones are those that the scorer rejects on its own
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = rows_of(clean)
    assert kept == rows_of(scored.where("not is_toxic").select(*docs.columns)) and 0 < every.total() - kept.total() < 0.2 * every.total()
    # near copies: ties within a group are the least id; rows that are equal in every column stand for each other
    left = rows_of(corpus_pipeline.drop_near_copies(spark, clean, folder))
    expected = by_hand_near_copies(sorted(kept.elements(), key=str))
    assert sum(left.values()) == sum(expected.values()) and Counter(r[:2] for r in left) == Counter(r[:2] for r in expected)
    # secrets: hexadecimal runs of one or two owners go, all else stays as it is
    masked = rows_of(corpus_pipeline.mask_secrets(spark, spark.createDataFrame([*left.elements()], docs.schema), folder))
    assert masked.total() == left.total() and not any(re.search("9f86d081", r[1] or "") for r in masked)
    texts = {r[:2] for r in left}
    changed = {r[0] for r in masked if r[:2] not in texts}
    assert changed <= {r[0] for r in left if re.search(r"[0-9a-f]{16}|AKIA|(?i:password|passwd|secret|token|api_?key)|gh[pousr]_|[sr]k_|PRIVATE", r[1] or "")}
    assert all(r[4] == len(r[1]) for r in masked if r[1] is not None)
    # packing: every piece of every document, gapless
    pieces = corpus_pipeline.run(spark, folder).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in masked.elements():
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected.update((r[0], k, a, min(4096, len(ids) - a), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == expected
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    for spans in held.values():
        edges = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [a for a, _ in sorted(spans)] == edges[:-1] and edges[-1] <= 4096


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_near_copies_by_row(spark):
    one, two = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    rows = [(5, one), (5, two), (3, one + " tail"), (7, ""), (7, ""), (None, two), (9, two), (4, None), (4, "another text of its own"), (4, "another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == Counter([(3, one + " tail"), (5, two), (7, ""), (7, ""), (4, None), (4, "another text of its own")])
