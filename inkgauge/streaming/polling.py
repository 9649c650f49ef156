"""Services that answer in pages, polled as a stream: a source `polled` that remembers (time, id) of every address.

A poll asks each address for the rows after the last one it gave, oldest first, and takes no more than a bounded number. The offset
lies in the query's checkpoint, so a query that starts again goes on behind its last complete batch, and a batch that is run
again reads the same range. Rows that don't fit the schema come through with their cause, for a table of their own.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType, TimestampType

PAGE, MOST, TRIES = 100, 1000, 3
CAUSE, RAW = "_cause", "_raw"


def fetched(url: str, token: str | None, tries: int = TRIES) -> dict:
    """A page; errors of the network are tried again after a while."""
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return json.load(answer)
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(2**n * 0.1)
    raise AssertionError


def moment(value: str) -> datetime:
    """A time in ISO form; one without a zone is UTC. ValueError if it is none."""
    if not isinstance(value, str):
        raise ValueError(f"not a time: {value!r}")
    at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class _Slice(InputPartition):
    """The rows of one address after start up to end, each a (time, id)."""

    def __init__(self, url: str, start: list, end: list):
        self.url, self.start, self.end = url, start, end


class PollingReader(DataSourceStreamReader):
    """One task for each address that has new rows; the driver sees their times and ids only, of one poll."""

    def __init__(self, options: dict, schema: StructType):
        self.urls = options["path"].split()
        self.page, self.most = int(options.get("pagesize", PAGE)), int(options.get("mostrows", MOST))
        self.time, self.id = options["timefield"], options.get("idfield", "id")
        self.since, self.where, self.token = options.get("since", ""), options.get("filter"), options.get("token")
        self.schema, self.at = schema, None

    def initialOffset(self) -> dict:
        return {u: [self.since, ""] for u in self.urls}

    def _rows(self, url: str, start: list, end: list | None, fields: str | None = None) -> Iterator[tuple[list, dict]]:
        """Rows after start, up to end, in the order of time and id, page by page. Rows without a time can't be placed and are no rows."""
        bounds = [self.where] if self.where else []
        bounds += [f"{self.time} ge {start[0]}"] if start[0] else []
        bounds += [f"{self.time} le {end[0]}"] if end else []
        args = {"$top": self.page, "$orderby": f"{self.time} asc,{self.id} asc"} | ({"$filter": " and ".join(bounds)} if bounds else {}) | ({"$select": fields} if fields else {})
        at = url + ("&" if "?" in url else "?") + urllib.parse.urlencode(args)
        key = lambda place: (moment(place[0]) if place[0] else datetime.min.replace(tzinfo=timezone.utc), place[1])
        while at:
            page = fetched(at, self.token)
            for row in page.get("value", []):
                place = [row.get(self.time), str(row.get(self.id, ""))]
                try:
                    here = key(place)
                except ValueError:
                    continue
                if place[0] and here > key(start) and (end is None or here <= key(end)):
                    yield place, row
            at = page.get("@odata.nextLink") or page.get("nextLink")

    def latestOffset(self) -> dict:
        """Behind the last row that the next batch takes: of each address at most mostrows more."""
        at = dict(self.initialOffset() | (self.at or {}))
        for url in self.urls:
            for n, (place, _) in enumerate(self._rows(url, at[url], None, f"{self.id},{self.time}"), 1):
                at[url] = place
                if n == self.most:
                    break
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        # a query that starts again plans its last batch once more, which tells where to go on
        self.at = self.at or end
        known = self.initialOffset() | start
        return [_Slice(u, known.get(u, [self.since, ""]), at) for u, at in end.items() if known.get(u) != at]

    def commit(self, end: dict) -> None:
        self.at = self.at or end

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for _, row in self._rows(partition.url, partition.start, partition.end):
            out, cause = [], None
            for f in self.schema.fields:
                value = None
                if f.name not in (CAUSE, RAW):
                    try:
                        value = cast(row.get(f.name), f.dataType)
                    except (TypeError, ValueError) as wrong:
                        cause = cause or f"{f.name}: {wrong}"
                out.append(value)
            names = self.schema.names
            if cause and CAUSE not in names:
                raise ValueError(f"a row of {partition.url} doesn't fit the schema, which has no {CAUSE}: {cause}")
            if cause:
                out[names.index(CAUSE)] = cause
                if RAW in names:
                    out[names.index(RAW)] = json.dumps(row)
            yield tuple(out)


def cast(value, kind):
    """A JSON value as kind; nested values of string columns as JSON. ValueError if it doesn't fit."""
    if value is None:
        return None
    if isinstance(kind, TimestampType):
        return moment(value)
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        if not isinstance(value, bool):
            raise ValueError(f"not true or false: {value!r}")
        return value
    if isinstance(kind, LongType):
        if isinstance(value, bool) or int(value) != float(value):
            raise ValueError(f"not a whole number: {value!r}")
        return int(value)
    if isinstance(kind, DoubleType):
        return float(value)
    raise ValueError(f"no values of {kind.simpleString()}")


class PollingSource(DataSource):
    """Options: path (addresses, blank-separated), timefield, idfield, since (a time to begin at), mostrows of an
    address in a batch, pagesize, filter (handed to the service, such as `isDraft eq false`), token.

    A schema of strings, longs, doubles, booleans and timestamps is given. With columns _cause and _raw (strings) rows that don't fit come with
    their cause and the row as JSON, and null where a value doesn't fit; without them such a row is an error. The service
    must keep to the order of time and id that is asked for. A row that appears later with a time before the offset isn't seen.
    """

    @classmethod
    def name(cls) -> str:
        return "polled"

    def streamReader(self, schema: StructType) -> PollingReader:
        return PollingReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes `spark.readStream.format("polled")` known."""
    spark.dataSource.register(PollingSource)


def write_polls(stream: DataFrame, path: str, dead: str, checkpoint: str, score=None, every: str | None = "30 seconds", on_poll=None) -> StreamingQuery:
    """Rows without cause go to the table at path, through score if given; the others go to dead, with cause, row and time of the batch.

    A bad row stops nothing. Each batch writes folders of its own (batch=<number>), which a second run of it overwrites, so
    both tables hold each row once. on_poll(number, counts) gets rows and bad of each batch, counted as they are written. Without every, what is
    there is taken and the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        seen = Observation()
        # kept, so that the service is asked once for both tables
        rows = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(CAUSE).alias("bad")).persist()
        good = rows.where(F.col(CAUSE).isNull()).drop(CAUSE, RAW)
        (score(good) if score else good).write.mode("overwrite").parquet(f"{path}/batch={number}")
        bad = rows.where(F.col(CAUSE).isNotNull()).select(F.col(CAUSE).alias("cause"), F.col(RAW).alias("row"), F.current_timestamp().alias("at"))
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        if on_poll:
            on_poll(number, seen.get)
        rows.unpersist()

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(once=True)).start()
