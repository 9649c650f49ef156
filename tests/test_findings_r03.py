"""What the third review found: each test failed before its change."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from inkgauge.functions import risk
from inkgauge.functions.lexicons import PAYLOAD
from inkgauge.operators import phrases
from inkgauge.operators import profiles as P
from inkgauge.plans import profile_queries, risk_queries
from inkgauge.plans.base import messages, rounded_as_sql

SF = "/root/testdata/sf0.001"


def rows_of(spark, folder, name):
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, str(folder)).collect()), key=str)
    con = duckdb.connect()
    for p in folder.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return got, sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_counts_has_no_rows_on_the_driver(spark, tmp_path, as_folder, monkeypatch):
    """ids are told apart in state on disk and rows go to files; an id counts for each of its types, a null one for none."""
    t = pq.read_table(f"{SF}/events.parquet").select(["event_id", "ts", "user_id", "event_type", "value", "props"])
    odd = t.slice(0, 3).set_column(3, "event_type", pa.array(["other", "other", "third"]))
    none = t.slice(3, 1).set_column(0, "event_id", pa.array([None], t.schema.field("event_id").type))
    (at := tmp_path / "in").mkdir()
    if as_folder:
        (at / "events.parquet").mkdir()
    pq.write_table(pa.concat_tables([t, t.slice(0, 50), odd, none]), at / "events.parquet" / "part.parquet" if as_folder else at / "events.parquet")
    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    got, want = rows_of(spark, at, "stream_counts")
    assert got == want
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before  # no table in the driver's memory


def test_equal_documents_count_each(spark, tmp_path):
    """times repeat after 500,000 numbers, so documents that are equal in all but the number are several."""
    t = pq.read_table(f"{SF}/documents.parquet")
    ids = pa.array([k + 500_000 for k in t["doc_id"].to_pylist()], t.schema.field("doc_id").type)
    pq.write_table(pa.concat_tables([t, t.set_column(t.schema.get_field_index("doc_id"), "doc_id", ids)]), tmp_path / "documents.parquet")
    got, want = rows_of(spark, tmp_path, "profiles_from_halves")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert got == want


def test_rounding_parts_ties_as_the_sql_does(spark):
    """three tenths of a score of six places are often within a bit of a tie; F.round goes by the digits."""
    got = spark.range(0, 200_000, 5).select("id", (F.lit(0.3) * (F.col("id") / F.lit(1e6))).alias("x"))
    got = got.select("id", "x", rounded_as_sql(F.col("x")).alias("ours"), rounded_as_sql(-F.col("x")).alias("below"), F.round("x", 6).alias("plain")).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    assert con.sql("SELECT count(*) FILTER (ours <> round(x, 6)), count(*) FILTER (below <> round(-x, 6)), count(*) FILTER (plain <> round(x, 6)) > 0 FROM got").fetchall() == [(0, 0, True)]
    odd = spark.createDataFrame([(None,), (float("inf"),), (1e300,), (0.0,)], "x double").select(rounded_as_sql(F.col("x")).alias("y"))
    assert [r.y for r in odd.collect()] == [None, float("inf"), 1e300, 0.0]


def test_only_labelled_documents_are_scored(spark, monkeypatch):
    """F5 to F11, F16, F18: what only labelled documents are asked isn't computed of the others."""
    seen, plain = [], risk_queries.scored
    monkeypatch.setattr(risk_queries, "_signals", {})
    monkeypatch.setattr(risk_queries, "scored", lambda s, m: seen.append(m.count()) or plain(s, m))
    n = risk_queries.signals(spark, SF).count()
    assert seen == [n] and n < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_any_of_the_payload_patterns(spark):
    """F5 to F11, F16, F18: one word's edge for all alternatives finds what each of them finds."""
    patterns = [p for ps in PAYLOAD.values() for _, p in ps]
    assert risk.ANY_AT_ALL.count(r"\b(?:") and all(not a.startswith(r"(?i)\b(?:\b") for a in (risk.ANY_AT_ALL, *risk.ANY.values()))
    texts = [f"{a} {w}{b}" for a in ("", "x", "é") for w in ("Gift card", "IBAN", "swift  code", "btc wallet", "w-2", "W2", "new ACH", "nothing", "payroll") for b in ("", "s", " é", "_")]
    texts += [t.replace(" ", "") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(risk.ANY_AT_ALL).alias("any"), F.array(*[F.col("t").rlike(f"(?i){p}") for p in patterns]).alias("each")).collect()
    assert all(r.any == any(r.each) for r in rows) and {r.any for r in rows} == {True, False}
    assert risk.either([r"a\b", r"\bb"]) == r"(?i)(?:a\b|\bb)" and risk.alternatives("a(b|c)|d") == ["a(b|c)", "d"]


def test_grams_of_messages_stay_in_their_tasks(spark, monkeypatch):
    """with few grams to look up no message's grams are shuffled; with many they are, and the values are the same."""
    benchmark, mail = spark.read.parquet(f"{SF}/benchmark.parquet"), messages(spark, SF)
    few = P.negative_space(benchmark, mail, "text")
    dealt = lambda df: re.findall(r"hashpartitioning\((?:msg_id#\d+L, gram|gram)", df._jdf.queryExecution().toString())
    assert not [d for d in dealt(few) if "msg_id" in d]
    monkeypatch.setattr(P, "BROADCAST_GRAMS", -1)
    many = P.negative_space(benchmark, mail, "text")
    assert [d for d in dealt(many) if "msg_id" in d]
    assert sorted(few.collect()) == sorted(many.collect())


def runs_by_hand(ws, pairs):
    every = [(i, n) for n in (2, 3, 4, 5) for i in range(len(ws) - n + 1)]
    return sorted(" ".join(ws[i : i + n]) for i, n in every if pairs is None or {" ".join(ws[i : i + 2]), " ".join(ws[i + n - 2 : i + n])} <= pairs)


@pytest.mark.parametrize("pairs", [None, {"a b", "b a"}])
def test_runs_hold_five_words(spark, pairs):
    """no run carries its whole sentence, however long that is."""
    texts = [["a"], [], ["a", "b"], list("abcab"), list("abcabbaab"), ["a", "b", "x", "y"] * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    found = phrases.runs(rows, ["id"], spark.createDataFrame([(p,) for p in pairs], "pair string") if pairs else None)
    got = {i: [] for i in range(len(texts))}
    for r in found.collect():
        got[r.id].append(r.phrase)
    assert {i: sorted(x) for i, x in got.items()} == {i: runs_by_hand(ws, pairs) for i, ws in enumerate(texts)}


def test_sentences_are_taken_apart_once_for_runs(spark, monkeypatch):
    """the runs of the commonest phrases are a written table, read for the ranking and for what is told of them."""
    made, plain = [], profile_queries.small
    monkeypatch.setattr(profile_queries, "small", lambda df: made.append(df.columns) or plain(df))
    profile_queries.top_phrases(spark, SF)
    assert ["msg_id", "author", "place", "phrase"] in made and ["pair", "n"] in made


def test_cells_are_made_of_the_told_phrases_alone(spark, monkeypatch):
    """counts decide which phrases are told of; sentences, domains and sources are gathered for these only."""
    made, plain = [], phrases.folded
    monkeypatch.setattr(phrases, "folded", lambda p: made.append(p.select("phrase").distinct().count()) or plain(p))
    assert phrases.phrase_records(messages(spark, SF), top=7, share=0.0).count() == 7 and made == [7]
