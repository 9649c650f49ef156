"""Mailboxes on servers: a data source `mailbox` that reads ranges of message numbers, newest first, by many tasks."""

from __future__ import annotations

import imaplib
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .mail import SCHEMA, row_of

#: Names under which servers keep sent mail, in the order in which they are tried; fixed values.
SENT = ("[Gmail]/Sent Mail", "Sent", "Sent Items", "Sent Messages", "INBOX.Sent")
SPLIT = 500  # messages of a task
TOGETHER = 20  # messages asked for at once


class _Numbers(InputPartition):
    def __init__(self, folder: str, low: int, high: int):
        self.folder, self.low, self.high = folder, low, high


def ranges(total: int, most: int | None, split: int) -> list[tuple[int, int]]:
    """Ranges of the newest most of total numbers, the newest first."""
    least = max(1, total - most + 1) if most is not None else 1
    return [(max(least, high - split + 1), high) for high in range(total, least - 1, -split)]


class MailboxReader(DataSourceReader):
    """The driver logs in once to plan: it picks the folder and cuts its numbers into ranges. Every task logs in for its own."""

    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options.get("port", 993))
        self.user, self.password = options["user"], options["password"]
        self.plain = options.get("plain", "false").lower() == "true"
        self.folders = [f.strip() for f in options["folders"].split(";")] if "folders" in options else list(SENT)
        self.most = int(options["most"]) if "most" in options else None
        self.split = int(options.get("split", SPLIT))

    def _login(self) -> imaplib.IMAP4:
        server = imaplib.IMAP4(self.host, self.port, timeout=60) if self.plain else imaplib.IMAP4_SSL(self.host, self.port, timeout=60)
        server.login(self.user, self.password)
        return server

    @staticmethod
    def _open(server: imaplib.IMAP4, folder: str) -> int | None:
        """How many messages the folder holds; None if there is none of that name. It is opened for reading only."""
        quoted = folder.replace("\\", "\\\\").replace('"', '\\"')
        said, found = server.select(f'"{quoted}"', readonly=True)
        return int(found[0]) if said == "OK" else None

    def partitions(self) -> list[_Numbers]:
        server = self._login()
        try:
            for folder in self.folders:
                total = self._open(server, folder)
                if total is not None:
                    return [_Numbers(folder, low, high) for low, high in ranges(total, self.most, self.split)] or [_Numbers(folder, 1, 0)]
        finally:
            server.logout()
        raise ValueError(f"{self.host} has none of the folders {', '.join(self.folders)}")

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        if partition.high < partition.low:
            return
        server = self._login()
        try:
            self._open(server, partition.folder)
            for low, high in ranges(partition.high - partition.low + 1, None, TOGETHER):
                said, found = server.fetch(f"{partition.low + low - 1}:{partition.low + high - 1}", "(BODY.PEEK[])")
                if said != "OK":
                    raise OSError(f"{self.host}: messages {low} to {high} weren't given: {found}")
                # parts that are pairs hold a message, others end one
                rows = [(int(re.match(rb"\d+", part[0]).group()), part[1]) for part in found if isinstance(part, tuple)]
                for number, raw in sorted(rows, reverse=True):
                    path, name, sent, *rest = row_of(f"{partition.folder}/{number}", raw)
                    yield path, name, None if sent is None else sent.tz_localize("UTC").to_pydatetime(), *rest
        finally:
            server.logout()


class MailboxSource(DataSource):
    """Options: host, port, user, password, folders (names parted by ;, the first that exists is read; those of SENT without), most (the
    newest so many), split (messages of a task), plain (true for a connection without TLS). Rows are those of the other mail readers; path is folder/number.

    Numbers may shift while others delete mail; then a row may come twice or not at all, as message_id tells.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MailboxReader:
        return MailboxReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes `spark.read.format("mailbox")` known."""
    spark.dataSource.register(MailboxSource)
