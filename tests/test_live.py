"""Streams: known pairs, the log sink, and the paged source."""

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from inkgauge.sources import paged
from inkgauge.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = "id long, author string, recipient string, sent timestamp"


def test_known_pairs_and_log(spark, tmp_path):
    """Counts go on from batch to batch; the log holds each message once, also when the query starts again."""
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    first = [(i, "ann", "bo" if i % 2 else None, START + timedelta(minutes=9 - i)) for i in range(5)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    run = lambda: live.write_log(live.with_known(spark.readStream.schema(SCHEMA).parquet(source), "author", "recipient", "sent"), log, check, "sent", every=None).awaitTermination()
    run()
    spark.createDataFrame([(9, "ann", "bo", START + timedelta(days=1)), (10, "cy", "bo", START)], SCHEMA).write.mode("append").parquet(source)
    run()
    run()
    got = {r.id: (r.n_sends, r.is_known) for r in spark.read.parquet(log).collect()}
    assert spark.read.parquet(log).count() == 7
    assert got == {4: (1, False), 2: (2, False), 0: (3, True), 3: (1, False), 1: (2, False), 9: (3, True), 10: (1, False)}


@pytest.fixture
def service():
    rows = [{"id": f"m{i}", "sentDateTime": f"2024-01-{i + 1:02}T00:00:00Z", "body": {"content": "x" * i}, "subject": None if i == 3 else "s"} for i in range(25)]
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            args = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(args)
            least = args.get("$filter", " ").split(" ")[-1]
            at, top = int(args.get("$skip", 0)), int(args["$top"])
            found = [r for r in rows if r["sentDateTime"] >= least]
            page = {"value": found[at:at + top]}
            if at + top < len(found):
                more = f"&%24filter={args['$filter'].replace(' ', '%20')}" if "$filter" in args else ""
                page["@odata.nextLink"] = f"http://127.0.0.1:{self.server.server_port}/?%24top={top}&%24skip={at + top}{more}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_paged_source(spark, service):
    url, asked = service
    paged.register(spark)
    df = spark.read.format("paged").schema("id string, sentDateTime timestamp, subject string, body string").option("pagesize", 10).option("timefield", "sentDateTime").load(url)
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 25 and rows["m3"].subject is None and json.loads(rows["m2"].body) == {"content": "xx"} and len(asked) == 3
    asked.clear()
    late = df.where(F.col("sentDateTime") > F.lit("2024-01-20").cast("timestamp"))
    assert sorted(r.id for r in late.collect()) == ["m20", "m21", "m22", "m23", "m24"]
    assert [a.get("$filter") for a in asked] == ["sentDateTime ge 2024-01-20T00:00:00Z"]
