"""Token counts of fields or sections from one encoding of the whole document.

The document is encoded once. Token lengths in bytes add up to token spans; section boundaries are offsets in the same
bytes; the two sorted lists are joined by binary search. A token that crosses a boundary goes to the section that
holds most of its characters, the earlier one on ties (rule "most"); or to the one where it starts ("start").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_model, worker_codec
from .common import text_or_empty

RULES = ("most", "start")


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets where lines start; a line holds its line end. Empty text: one empty line."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate([[0], ends])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def characters(raw: bytes) -> int:
    """Code points that start in these bytes."""
    return int((np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).sum())


def attribute(raw: bytes, lengths: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, given each token's bytes and each section's first byte (from 0, ascending)."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    section = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    if rule == "most":
        for i in np.flatnonzero(section != last):
            edges = [begins[i], *starts[section[i] + 1 : last[i] + 1], ends[i]]
            held = [characters(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            section[i] += int(np.argmax(held))
    return np.bincount(section, minlength=len(starts))


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", field_cols: tuple[str, ...] = (), rule: str = "most") -> DataFrame:
    """A row for each section: id_col, section (from 0), field, start, end (code points, end exclusive), n_tokens, doc_tokens.

    Without field_cols the sections are the lines of text_col. With them the document is those columns joined by line
    ends, and each column is a section. The sections of a document cover it, so their n_tokens add up to doc_tokens.
    Null texts and fields count as empty; an empty document has one section (or one a field) without tokens. Repeated
    rows and ids stand alone; other columns are ignored. A map over rows without shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    model = shared_model(docs, ranks_path)
    cols = field_cols or (text_col,)
    src = docs.select(F.col(f"`{id_col}`").alias(id_col), *[text_or_empty(c).alias(f"__f{i}") for i, c in enumerate(cols)])
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value, pattern)
        for batch in batches:
            fields = [batch.column(i + 1).to_pylist() for i in range(len(cols))]
            take, section, start, end, count, total = [], [], [], [], [], []
            for row, parts in enumerate(zip(*fields, strict=True)):
                text = "\n".join(parts)
                raw = text.encode()
                lengths = codec.lengths[codec.encode(text)]
                if field_cols:
                    starts = np.cumsum([0, *(len(p.encode()) + 1 for p in parts[:-1])])
                else:
                    starts = line_starts(raw)
                counts = attribute(raw, lengths, starts, rule)
                if len(raw) == len(text):
                    edges = [*starts.tolist(), len(raw)]
                else:
                    first = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
                    edges = [*first[starts].tolist(), len(text)]
                k = len(starts)
                take += [row] * k
                section += range(k)
                start += edges[:-1]
                end += edges[1:]
                count += counts.tolist()
                total += [len(lengths)] * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(section, pa.int32()), pa.array([cols[s] if field_cols else text_col for s in section], pa.string())]
                + [pa.array(x, pa.int64()) for x in (start, end, count, total)],
                [id_col, "section", "field", "start", "end", "n_tokens", "doc_tokens"],
            )

    return src.mapInArrow(run, f"`{id_col}` {kind}, section int, field string, start long, end long, n_tokens long, doc_tokens long")
