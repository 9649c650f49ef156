"""A mailbox server in a thread: folders are tried in order, numbers are read in ranges, newest first, whatever the tasks."""

import socketserver
import threading

import pytest

from inkgauge.sources import mailbox


class Talk(socketserver.StreamRequestHandler):
    def say(self, line: str) -> None:
        self.wfile.write(line.encode() + b"\r\n")

    def handle(self) -> None:
        self.say("* OK ready")
        box = []
        while line := self.rfile.readline().decode().strip():
            tag, command, *rest = line.split(" ", 2)
            words = rest[0] if rest else ""
            self.server.said.append(f"{command} {words}".strip())
            if command == "CAPABILITY":
                self.say("* CAPABILITY IMAP4rev1")
            elif command == "LOGIN" and "wrong" in words:
                self.say(f"{tag} NO denied")
                continue
            elif command in ("EXAMINE", "SELECT"):
                name = words.strip('"')
                if name not in self.server.boxes:
                    self.say(f"{tag} NO no such folder")
                    continue
                box = self.server.boxes[name]
                self.say(f"* {len(box)} EXISTS")
            elif command == "FETCH":
                low, high = map(int, words.split(" ")[0].split(":"))
                for n in range(low, min(high, len(box)) + 1):
                    raw = box[n - 1]
                    self.wfile.write(f"* {n} FETCH (BODY[] {{{len(raw)}}}\r\n".encode() + raw + b")\r\n")
            elif command == "LOGOUT":
                self.say("* BYE")
            self.say(f"{tag} OK done")


@pytest.fixture
def server():
    s = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Talk)
    s.daemon_threads, s.said = True, []
    raw = lambda i: f"From: Lee <lee@example.com>\r\nTo: a{i}@example.org\r\nSubject: m{i}\r\nDate: Mon, 01 Jan 2024 10:{i // 60:02}:{i % 60:02} +0000\r\n\r\nbody {i}\r\n".encode()
    s.boxes = {"Sent Items": [raw(i) for i in range(1, 138)], "Empty": [], 'Odd "one"': [raw(1)]}
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def read(spark, server, **options):
    mailbox.register(spark)
    reader = spark.read.format("mailbox").option("host", "127.0.0.1").option("port", server.server_address[1]).option("user", "u").option("password", "p").option("plain", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_ranges():
    assert mailbox.ranges(10, None, 4) == [(7, 10), (3, 6), (1, 2)] and mailbox.ranges(10, 5, 4) == [(7, 10), (6, 6)]
    assert mailbox.ranges(0, None, 4) == [] == mailbox.ranges(3, 0, 4)


def test_newest_by_ranges(spark, server):
    df = read(spark, server, most=100, split=30)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert [r.subject for r in rows] == [f"m{i}" for i in range(137, 37, -1)]
    assert rows[0].path == "Sent Items/137" and rows[0].to_addrs == ["a137@example.org"] and rows[0].body == "body 137\r\n"
    assert all(s.split(" ")[0] != "SELECT" for s in server.said)


def test_folders(spark, server):
    assert read(spark, server).count() == 137
    assert read(spark, server, folders="None such; Empty").count() == 0
    with pytest.raises(Exception, match="none of the folders"):
        read(spark, server, folders="None such").count()
    with pytest.raises(Exception, match="denied"):
        read(spark, server, password="wrong").count()
