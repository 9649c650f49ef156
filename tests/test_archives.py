"""Archives cut at any place give the messages of one pass; tar streams give the members in order."""

import gzip
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from inkgauge.sources import archives, mail

BODIES = [f"Subject: m{i}\n\nbody {i}\n" + "line\n" * i + (">From quoted\n" if i % 3 == 0 else "") for i in range(12)]
MBOX = "".join(f"From someone@example.com Mon Jan 1\n{b}\n" for b in BODIES).encode()


@pytest.fixture
def split_bytes(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("size", [7, 8, 31, 64, 101, 500, 10**6])
def test_mbox_ranges(spark, tmp_path, split_bytes, size):
    (tmp_path / "a.mbox").write_bytes(MBOX)
    split_bytes(size)
    df = archives.mbox_messages(spark, str(tmp_path))
    assert sorted(bytes(r.content).strip() for r in df.collect()) == sorted(b.encode().strip() for b in BODIES)
    assert df.rdd.getNumPartitions() >= min(40, len(MBOX) // size)
    assert sorted(r.subject for r in mail.read_mbox(spark, str(tmp_path)).collect()) == sorted(f"m{i}" for i in range(12))


def test_mbox_packed_and_bytes(spark, tmp_path):
    """Compressed files, line ends of two characters, and bytes that aren't UTF-8."""
    (tmp_path / "a.mbox.gz").write_bytes(gzip.compress(MBOX.replace(b"\n", b"\r\n")))
    (tmp_path / "b.mbox").write_bytes(b"From x\nSubject: raw\nContent-Type: text/plain; charset=latin-1\n\ncaf\xe9\n")
    (tmp_path / "c.mbox").write_bytes(b"")
    rows = {r.subject: r.body for r in mail.read_mbox(spark, str(tmp_path)).collect()}
    assert len(rows) == 13 and rows["raw"].strip() == "café"


def test_mbox_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: a message every 8 MB, read by many tasks."""
    at, step, n = tmp_path / "big.mbox", 8 << 20, 3 * 128
    with open(at, "wb") as f:
        for i in range(n):
            f.seek(i * step)
            f.write((b"\n" if i else b"") + b"From x\nSubject: m%d\n\n" % i)
        f.truncate(n * step)
    assert os.path.getsize(at) == 3 << 30
    lines = spark.read.option("lineSep", "\nFrom ").text(str(at))
    found = lines.select(F.regexp_extract(F.substring("value", 1, 100), "Subject: m(\\d+)", 1).cast("int").alias("i"))
    assert lines.rdd.getNumPartitions() >= 24
    got = found.agg(F.count("*"), F.count_distinct("i"), F.max("i")).first()
    assert tuple(got) == (n, n, n - 1)


def packed(files: list[tuple[str, bytes]], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, raw in files:
            member = tarfile.TarInfo(name)
            member.size = len(raw)
            tar.addfile(member, io.BytesIO(raw))
    return out.getvalue()


@pytest.mark.parametrize("size", [100, 5000, 10**7])
def test_tar_streams(spark, tmp_path, split_bytes, size):
    """Members of several archives, with bytes of all kinds, however the files are cut."""
    kinds = {"a.tar": "w:", "b.tar.gz": "w:gz"}
    files = {name: [(f"maildir/{name[0]}/sent/{i}", bytes(range(256)) * (i % 5) + b"\r\n\n\r" * i) for i in range(40)] for name in kinds}
    for name, mode in kinds.items():
        (tmp_path / name).write_bytes(packed(files[name], mode))
    (tmp_path / "c.tar").write_bytes(packed(files["a.tar"][:3], "w:")[:1300])  # ends within a member
    split_bytes(size)
    rows = archives.tar_members(spark, str(tmp_path)).collect()
    for name in kinds:
        assert sorted((r.path, bytes(r.content)) for r in rows if r.archive.endswith(name)) == sorted(files[name])
    assert [r.path for r in rows if r.archive.endswith("c.tar")][-1] is None
    small = archives.tar_members(spark, str(tmp_path / "a.tar"), limit=300).collect()
    assert {r.path.rsplit("/", 1)[1] for r in small if r.content is None} == {str(i) for i, (_, raw) in enumerate(files["a.tar"]) if len(raw) > 300}


def test_archive_newest(spark, tmp_path):
    raw = lambda day: b"From: a@example.com\nDate: Mon, %02d Jan 2024 10:00:00 +0000\nSubject: d%d\n\nhi\n" % (day, day)
    (tmp_path / "m.tar.gz").write_bytes(packed([(f"maildir/lee/sent/{d}", raw(d)) for d in range(1, 9)] + [("maildir/lee/inbox/1", raw(9))], "w:gz"))
    assert sorted(r.subject for r in mail.read_archive(spark, str(tmp_path / "m.tar.gz"), most=2).collect()) == ["d7", "d8"]
    assert mail.read_archive(spark, str(tmp_path / "m.tar.gz"), sent_only=False).count() == 9
