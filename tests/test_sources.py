"""Mail sources, streams and models on small inputs."""

from pyspark.sql import functions as F

from inkgauge.operators.style_model import isolation_scores
from inkgauge.functions import text as T
from inkgauge.operators import profiles
from inkgauge.sources import mail, store
from inkgauge.streaming import live

RAW = b"From: Lee <lee@example.com>\nTo: Ana <ANA@example.com>, bo@example.org\nDate: Mon, 01 Jan 2024 10:00:00 +0200\nMessage-ID: <1@x>\nSubject: =?utf-8?q?Caf=C3=A9?=\n\nHello\n"


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(RAW)
    (tmp_path / "b.mbox").write_bytes(b"From x\n" + RAW + b"From y\n" + RAW)
    box = tmp_path / "maildir/lee-x/sent"
    box.mkdir(parents=True)
    (box / "1.").write_bytes(RAW)
    r = mail.read_eml(spark, str(tmp_path)).first()
    assert (r.from_addr, r.to_addrs, r.subject, r.body, str(r.sent)) == ("lee@example.com", ["ana@example.com", "bo@example.org"], "Café", "Hello\n", "2024-01-01 08:00:00")
    assert mail.read_mbox(spark, str(tmp_path)).count() == 2
    r = mail.read_maildir(spark, str(tmp_path)).first()
    assert (r.owner, r.folder) == ("lee-x", "sent")


def test_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"body_text": "' + "word " * 25 + '", "recipient": "a"}, {"body_text": "short", "recipient": "b"}]')
    assert [r.to for r in mail.read_corpus(spark, str(tmp_path / "c.json")).collect()] == ["a"]


def test_scored(spark):
    df = spark.createDataFrame([("a", "buy gift cards"), ("a", "hello")], "author string, body string")
    assert sorted(r.verdict for r in live.scored(df, "body").collect()) == ["hold", "pass"]


def test_forest(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, 1000.0).otherwise(F.col("id") % 10).alias("x"))
    assert isolation_scores(df, ["x"], "doc_id").orderBy(F.desc("anomaly")).first().doc_id == 7


def test_corpus_forms(spark, tmp_path):
    """JSON lines, wrapped objects and arrays give the same messages."""
    import json

    rows = [{"body": "word " * 25, "to": str(i)} for i in range(3)]
    for name, text in (("lines", "\n".join(map(json.dumps, rows))), ("array", json.dumps(rows)), ("messages", json.dumps({"messages": rows})), ("emails", json.dumps({"emails": rows, "n": 3}))):
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted(r.to for r in mail.read_corpus(spark, str(tmp_path / f"{name}.json")).collect()) == ["0", "1", "2"]
    (tmp_path / "segments.json").write_text(json.dumps(["Lee: [00:01] " + "word " * 12, {"text": "again " * 12, "id": "x"}, "short"]))
    assert sorted((r.source_id, r.body) for r in mail.read_segments(spark, str(tmp_path / "segments.json")).collect()) == [("src_0", ("word " * 12).strip()), ("x", ("again " * 12).strip())]
    assert mail.from_texts(spark, ["a b", "word " * 10]).first().source_id == "src_1"


def test_mail_rules(spark, tmp_path):
    import tarfile

    box = tmp_path / "maildir/lee/sent"
    box.mkdir(parents=True)
    (box / "1").write_bytes(RAW)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "maildir", "maildir")
    assert [(r.owner, r.subject) for r in mail.read_archive(spark, str(tmp_path / "a.tar.gz")).collect()] == [("lee", "Café")]
    df = spark.createDataFrame([("a", "2024-01-20 00:00:00", "one two three four five"), ("b", "2023-01-01 00:00:00", "one two three four five"), ("c", None, "one two three four five\n> old"), ("d", None, "short")], "message_id string, sent string, body string").withColumn("sent", F.col("sent").cast("timestamp"))
    assert sorted(r.message_id for r in mail.own_mail(df, 1, "2024-02-01").collect()) == ["a", "c"]
    texts = spark.createDataFrame([("Hi\n> quoted\nbody\nOn Monday Lee wrote:\nold",), ("a\nb\nc\nd\nFrom: x\nSent: y\nold",), ("text here\nmore text\n\nLee Doe\nManager\n555-123-4567",)], "t string")
    assert [r[0] for r in texts.select(T.strip_quotes(F.col("t"))).collect()] == ["Hi\nbody", "a\nb\nc\nd", "text here\nmore text\n\nLee Doe"]


def test_store(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    store.upsert(df([(1, "a"), (2, "b")]), f"{at}/t", ["k"])
    store.upsert(df([(2, "c"), (3, "d")]), f"{at}/t", ["k"])
    assert sorted(map(tuple, store.load(spark, f"{at}/t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.replace(df([(9, "z")]), f"{at}/t")
    assert store.load(spark, f"{at}/t").count() == 1
    store.append(df([(1, "a"), (1, "a")]), f"{at}/log", once=["k"])
    store.append(df([(1, "x"), (2, "y")]), f"{at}/log", once=["k"])
    assert sorted(map(tuple, spark.read.parquet(f"{at}/log").collect())) == [(1, "a"), (2, "y")]
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id long")
    store.insert_tenants(tenants, f"{at}/tenants", f"{at}/policies")
    store.insert_tenants(tenants, f"{at}/tenants", f"{at}/policies")
    assert spark.read.parquet(f"{at}/policies").count() == 2
    store.split(spark.range(400).withColumnRenamed("id", "doc_id"), "doc_id", f"{at}/split")
    assert [store.load(spark, f"{at}/split/{n}").count() for n in ("heldout", "seed", "train")] == [300, 5, 95]
    users = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, tenant_id long")
    layers = [("group", spark.createDataFrame([(1, 5, 1, 0.9), (1, 5, 2, 0.8)], "user_id long, priority int, policy_id long, warn double"), "user_id"), ("tenant", spark.createDataFrame([(2, 0.7)], "tenant_id long, warn double"), "tenant_id")]
    got = {r.user_id: (r.warn, r.warn_source, r.hold, r.hold_source) for r in store.effective_policy(users, layers, {"warn": 0.35, "hold": 0.55}).collect()}
    assert got == {1: (0.9, "group", 0.55, "constant"), 2: (0.7, "tenant", 0.55, "constant")}


def test_reasons(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 0.1)], "a double, b double")
    got = [r.reasons for r in profiles.top_reasons(df, ["a", "b"], {"a": 0.0, "b": 0.0}, {"a": 2.0, "b": 1.0}).collect()]
    assert got == [["a: 10.00 (higher than typical 0.00, z=5.0)"], ["overall linguistic pattern deviates from user baseline"]]


def test_store_dead_writers(spark, tmp_path):
    """Versions that no writer finished don't count, and never push out a complete one."""
    at = f"file://{tmp_path}/t"
    df = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    held = lambda: sorted(r.k for r in store.load(spark, at).collect())
    store.replace(df(1), at)
    for n in (1, 2):  # dead before the rows were whole, and between claim and entry
        (tmp_path / f"t/data/dead{n}").mkdir()
        (tmp_path / f"t/claims/{n:012}").touch()
    (tmp_path / "t/log/000000000002-dead2").touch()
    assert held() == [1]
    store.replace(df(2), at)
    assert held() == [2] and len(store.versions(spark, at)) == 2
    store.upsert(df(3), at, ["k"])
    assert held() == [2, 3] and len(store.versions(spark, at)) == 2 and (tmp_path / "t/data/dead1").exists()


def test_store_two_writers(spark, tmp_path, monkeypatch):
    """An upsert that another writer overtakes goes on top of that one's rows."""
    at = f"file://{tmp_path}/t"
    df = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    store.upsert(df((1, "a")), at, ["k"])
    publish, overtaken = store._publish, []

    def late(spark, path, folder, number):
        if not overtaken:
            overtaken.append(1)
            store.upsert(df((2, "other")), at, ["k"])
        return publish(spark, path, folder, number)

    monkeypatch.setattr(store, "_publish", late)
    store.upsert(df((1, "b"), (3, "c")), at, ["k"])
    assert sorted(map(tuple, store.load(spark, at).collect())) == [(1, "b"), (2, "other"), (3, "c")]


def test_store_logs(spark, tmp_path):
    at = f"file://{tmp_path}"
    found = spark.createDataFrame([(1, "n1", [("wire", 2), ("gift", 1)])], "msg_id long, name string, matches array<struct<name: string, n: long>>")
    store.log_hits(found, f"{at}/hits")
    assert sorted(map(tuple, spark.read.parquet(f"{at}/hits").select("msg_id", "name", "match_name", "n").collect())) == [(1, "n1", "gift", 1), (1, "n1", "wire", 2)]
    for run, auc in (("r1", 0.5), ("r2", 0.9)):
        store.log_run(spark.createDataFrame([("auc", auc)], "metric string, value double"), f"{at}/runs", run)
    assert [(r.run_id, r.value) for r in store.latest_run(spark, f"{at}/runs").collect()] == [("r2", 0.9)]
    store.log_scores(spark.createDataFrame([(1, 0.4, "warn", 7)], "msg_id long, score double, verdict string, tenant_id long"), f"{at}/scores", "2024-01-02 00:00:00")
    hits = spark.createDataFrame([(7, "wire", 2, "2024-01-01 12:00:00"), (8, "wire", 9, "2024-01-01 12:00:00")], "tenant_id long, pattern_type string, match_count long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    tenants = spark.createDataFrame([(7, 1), (8, 2)], "tenant_id long, reseller_id long")
    users = spark.createDataFrame([(1, 7, "ready"), (2, 7, "none"), (3, 8, "ready")], "user_id long, tenant_id long, cpp_status string")
    got = {(r.kind, r.name): r.n for r in store.stats(spark.read.parquet(f"{at}/scores"), hits, users, tenants, {"reseller_id": 1}, "2024-01-02 06:00:00").collect()}
    assert got == {("verdict", "warn"): 1, ("pattern", "wire"): 2, ("users", "users"): 2, ("users", "ready"): 1}
    store.insert_allowed(spark.createDataFrame([(7, "p", 1)], "tenant_id long, policy_name string, stray long"), f"{at}/policies")
    assert spark.read.parquet(f"{at}/policies").columns == ["tenant_id", "policy_name"]
    store.save_profiles_json(spark.createDataFrame([("a", 1.5)], "author string, avg double"), f"{at}/json")
    assert spark.read.json(f"{at}/json/profiles").first().asDict() == {"author": "a", "avg": 1.5}


def test_corpus_mixed_folder(spark, tmp_path):
    """Each file of a folder is read in its own form; blank lines and strings that begin with a brace are kept apart."""
    import json

    row = lambda i: {"body": "word " * 25, "to": str(i)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/lines.json").write_text("\n" + "\n\n".join(json.dumps(row(i)) for i in range(3)) + "\n")
    (tmp_path / "c/emails.json").write_text(json.dumps({"emails": [row(3), row(4)]}, indent=1))
    (tmp_path / "c/array.json").write_text(json.dumps([row(5), "stray", row(6)], indent=1))
    (tmp_path / "c/one.json").write_text(json.dumps(row(7), indent=1))
    assert sorted(r.to for r in mail.read_corpus(spark, str(tmp_path / "c")).collect()) == list("01234567")
    assert [r.to for r in mail.read_corpus(spark, str(tmp_path / "c/lines.json"), lines=True).orderBy("to").collect()] == ["0", "1", "2"]
    (tmp_path / "s.json").write_text(json.dumps(["{not an object} " + "word " * 12, {"text": "again " * 12, "id": "x", "title": "t"}]))
    got = {r.source_id: (r.body, r.title) for r in mail.read_segments(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"src_0": (("{not an object} " + "word " * 12).strip(), None), "x": (("again " * 12).strip(), "t")}


def test_mail_selections(spark, tmp_path):
    df = spark.createDataFrame([("a", "m1", "2024-01-01"), ("a", "m2", "2024-01-03"), ("a", "m3", None), ("b", "m4", None)], "owner string, message_id string, sent string").withColumn("sent", F.col("sent").cast("timestamp"))
    assert sorted(r.message_id for r in mail.capped(df, "owner", 2).collect()) == ["m1", "m2", "m4"]
    mails = spark.createDataFrame([("Re: x", "thank you for the long answer\n\nLee"), ("Weekly newsletter", "unsubscribe here " * 5), ("FW: y", "short")], "subject string, body string")
    assert [(r.is_reply, r.is_forward, r.word_count) for r in mail.exported_mail(mails).collect()] == [(True, False, 7)]
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.eml").write_text("two")
    (tmp_path / "c.pdf").write_text("no")
    assert [r.text for r in mail.read_folder(spark, str(tmp_path)).collect()] == ["one", "two"]


def scanned(df):
    """df's rows, and how many rows its scan read."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


def test_lookups_skip_row_groups(spark, tmp_path):
    """A look-up by the key of the order, or by a column with a filter, reads a few row groups of many."""
    at = f"file://{tmp_path}/t"
    df = spark.range(60000).select(F.col("id").alias("tenant_id"), F.md5(F.col("id").cast("string")).alias("domain"), F.md5((F.col("id") * 7).cast("string")).alias("plain"))
    store.clustered(df.repartition(3), at, ["tenant_id"], ["domain"], row_group_bytes=64 << 10, distinct=5000)
    wanted = df.where("tenant_id = 4321").first()
    for column, value in (("tenant_id", 4321), ("domain", wanted.domain)):
        rows, read = scanned(store.find(spark, at, **{column: value}))
        assert [r.tenant_id for r in rows] == [4321] and read < 20000, (column, read)
    rows, read = scanned(store.find(spark, at, plain=wanted.plain))
    assert [r.tenant_id for r in rows] == [4321] and read == 60000
    assert sorted(r.tenant_id for r in store.find(spark, at, tenant_id=[5, 59999]).collect()) == [5, 59999]
    assert store.find(spark, f"{at}-none", tenant_id=1) is None


def test_selections(spark):
    users = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "user_id long, group_ids array<string>")
    assert [r.user_id for r in store.members(users, ["b", "x"]).collect()] == [1] and store.members(users, []).count() == 0
    mails = spark.createDataFrame([("Lee-X", "1"), ("bo", "2"), (None, "3")] + [("cy", str(i)) for i in range(12)], "owner string, id string")
    assert {r.id for r in mail.of_accounts(mails, ["lee", "bo"]).collect()} == {"1", "2"} and mail.of_accounts(mails, []).count() == 15
    assert {r.owner for r in mail.enough(mails, "owner").collect()} == {"cy"}
    own = spark.createDataFrame([("word " * 25,), ("both " * 25,), ("short",)], "body string")
    got = {(r.body.split(" ")[0], r.label) for r in mail.labelled(own, [spark.createDataFrame([("both " * 25,), ("other " * 25,)], "body string")]).collect()}
    assert got == {("word", 1.0), ("both", 1.0), ("other", 0.0)}
