"""Polled services: each row once, over polls, restarts and bad rows."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import risk
from inkgauge.streaming import polling

SCHEMA = "id string, sentDateTime timestamp, size long, body string, _cause string, _raw string"


class Service:
    """Pages of mailboxes by time and id, as asked for; fails once in a while."""

    def __init__(self):
        self.boxes, self.asked, self.fail = {"a": [], "b": []}, [], 0
        service = self

        class Answer(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                args = {k: v[0] for k, v in parse_qs(at.query).items()}
                service.asked.append((at.path[1:], args))
                if service.fail:
                    service.fail -= 1
                    return self.send_error(503)
                rows = sorted(service.boxes[at.path[1:]], key=lambda r: (r["sentDateTime"], r["id"]))
                for op, bound in re.findall(r"sentDateTime (ge|le) (\S+)", args.get("$filter", "")):
                    rows = [r for r in rows if (r["sentDateTime"] >= bound if op == "ge" else r["sentDateTime"] <= bound)]
                if "isDraft eq false" in args.get("$filter", ""):
                    rows = [r for r in rows if not r.get("isDraft")]
                skip, top = int(args.get("$skip", 0)), int(args["$top"])
                page = {"value": rows[skip : skip + top]}
                if skip + top < len(rows):
                    page["@odata.nextLink"] = f"http://127.0.0.1:{self.server.server_port}{at.path}?" + urlencode(args | {"$skip": skip + top})
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(page).encode())

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Answer)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.urls = " ".join(f"http://127.0.0.1:{self.server.server_port}/{b}" for b in self.boxes)

    def add(self, box, ids, **more):
        self.boxes[box] += [{"id": f"{box}{i:03}", "sentDateTime": f"2024-01-01T00:{i // 3:02}:00Z", "size": i, "body": {"content": "x"}} | more for i in ids]


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_polls_and_restarts(spark, tmp_path, service):
    """Three polls with a restart before each; equal times are cut anywhere; a failed page is asked for again."""
    polling.register(spark)
    service.add("a", range(10))
    service.add("b", range(4))
    service.add("a", [90], isDraft=True)
    out, dead, check = (str(tmp_path / n) for n in ("out", "dead", "check"))
    counts = []

    def poll():
        stream = spark.readStream.format("polled").schema(SCHEMA).option("timefield", "sentDateTime").option("mostrows", 7).option("pagesize", 3).option("filter", "isDraft eq false").load(service.urls)
        before = set() if not counts else {r.id for r in spark.read.parquet(out).collect()}
        polling.write_polls(stream, out, dead, check, every=None, on_poll=lambda n, c: counts.append(c)).awaitTermination()
        rows = [r.id for r in spark.read.parquet(out).collect()]
        assert len(rows) == len(set(rows))
        return set(rows) - before

    assert poll() == {f"a{i:03}" for i in range(7)} | {f"b{i:03}" for i in range(4)}
    service.add("a", range(20, 22))
    service.fail = 1
    assert poll() == {"a007", "a008", "a009", "a020", "a021"}
    service.add("b", range(4, 6))
    assert poll() == {"b004", "b005"}
    assert [c["rows"] for c in counts[:3]] == [11, 5, 2] and sum(c["bad"] for c in counts) == 0
    assert any("ge 2024-01-01T00:02:00Z" in a.get("$filter", "") for _, a in service.asked)


def test_dead_letters(spark, tmp_path, service):
    """One bad row of 100 leaves 99 scored and one dead letter."""
    polling.register(spark)
    service.add("a", range(100))
    service.boxes["a"][42]["size"] = "many"
    service.boxes["a"][43]["body"] = "please send gift cards"
    out, dead, counts = str(tmp_path / "out"), str(tmp_path / "dead"), []
    stream = spark.readStream.format("polled").schema(SCHEMA).option("timefield", "sentDateTime").load(service.urls)
    score = lambda df: df.withColumn("score", risk.payload_score(risk.payload_hits(F.col("body"))))
    polling.write_polls(stream, out, dead, str(tmp_path / "check"), score=score, every=None, on_poll=lambda n, c: counts.append(c)).awaitTermination()
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    assert len(rows) == 99 and "a042" not in rows and rows["a043"].score > 0 == rows["a044"].score
    letters = spark.read.parquet(dead).collect()
    assert len(letters) == 1 and letters[0].cause.startswith("size:") and json.loads(letters[0].row)["id"] == "a042"
    assert counts == [{"rows": 100, "bad": 1}]


def test_cast():
    from pyspark.sql import types as T

    assert polling.cast({"a": 1}, T.StringType()) == '{"a": 1}' and polling.cast(None, T.LongType()) is None and polling.cast(2.0, T.LongType()) == 2
    for value, kind in (("x", T.LongType()), (1.5, T.LongType()), ("x", T.DoubleType()), ("yes", T.BooleanType()), ("soon", T.TimestampType()), (True, T.LongType())):
        with pytest.raises(ValueError):
            polling.cast(value, kind)
