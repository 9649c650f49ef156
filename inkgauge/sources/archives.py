"""Mail archives of any size: mbox files in byte ranges, tar files as streams of members.

Both are read by Spark's text reader with a line end of their own, so that they may lie wherever Spark can read, may be
compressed, and are never whole in memory. An mbox file is cut at "From " lines: a task that begins inside a message skips to the
next one, and the task before reads that message to its end. A tar file has no such marks; its pieces are put in order and its members
are taken off one after the other.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_BYTES = 1 << 28  # of a tar member; a longer one isn't mail, and is named in the result without content


def mbox_messages(spark: SparkSession, folder: str, glob: str = "*.mbox*") -> DataFrame:
    """path and content (binary) of every message; the separating lines are left out, files without any give nothing.

    How many tasks read a file is up to spark.sql.files.maxPartitionBytes; compressed files are one task each.
    """
    pieces = spark.read.option("lineSep", "\nFrom ").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # what is before the first line end is the rest of the separating line
            bodies = [raw.partition(b"\n")[2] for raw in b.column("raw").to_pylist()]
            keep = pa.array([bool(x.strip()) for x in bodies], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(bodies, pa.binary())], ["path", "content"]).filter(keep)

    return pieces.mapInArrow(run, "path string, content binary")


class _Pieces(io.RawIOBase):
    """The bytes of one file, pulled line by line as a reader asks for them."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.held = lines, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        if not self.held:
            line = next(self.lines, None)
            if line is None:
                return 0
            self.held = memoryview(line + b"\n")
        n = min(len(out), len(self.held))
        out[:n] = self.held[:n]
        self.held = self.held[n:]
        return n


def _members(archive: str, lines: Iterator[bytes], limit: int) -> Iterator[tuple[str, str, bytes | None]]:
    try:
        with tarfile.open(fileobj=io.BufferedReader(_Pieces(lines), 1 << 16), mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    yield archive, member.name, tar.extractfile(member).read() if member.size <= limit else None
    except tarfile.ReadError:
        yield archive, None, None  # not an archive, or one that ends too early
    for _ in lines:  # what follows the end of an archive belongs to it
        pass


def tar_members(spark: SparkSession, path: str, limit: int = MEMBER_BYTES) -> DataFrame:
    """archive, path, content of every plain file in tar archives, which may be compressed with gzip or bzip2.

    One task goes through an archive, a member in memory at a time; archives are spread over tasks, and what is done with
    the members can be dealt anew. A member over limit bytes has no content. An archive that can't be read to its end gives the members before
    and a row without path.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("line"))
    ordered = placed.repartition("archive").sortWithinPartitions("archive", "block", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("archive").to_pylist(), b.column("line").to_pylist(), strict=True))
        ahead = next(rows, None)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["archive", "path", "content"])

        while ahead:
            archive = ahead[0]

            def its_lines() -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == archive:  # noqa: B023
                    line = ahead[1]
                    ahead = next(rows, None)
                    yield line

            for member in _members(archive, its_lines(), limit):
                held.append(member)
                size += len(member[2] or b"")
                if len(held) == 1000 or size > 1 << 24:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return ordered.mapInArrow(run, "archive string, path string, content binary")
