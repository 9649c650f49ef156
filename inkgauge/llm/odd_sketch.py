"""Near copies by odd sketches: MinHash samples in bands meet, parity bitmaps tell which of those that met are worth a full comparison.

A node is a distinct set of shingles; equal sets are one node. Its MinHash samples are cut into bands, and nodes that agree in
a band meet. The samples, each with its place, are also folded into a bitmap by parity: the bits in which two bitmaps differ
estimate in how many samples two sets differ, most precisely where that is few. A second bitmap folds the shingles
themselves; bits in which two of these differ stand for different shingles of one set only, so it rules out for
certain. Pairs that pass both are compared on their full sets.

Those that meet aren't expanded into all pairs. Each band value has a hub, its smallest node, and all others are compared
with it. Then, only where nodes that share a hub are still in several components, are those of different
components compared, in units of bounded size; nodes of one component need no more links. So a group of thousands of copies costs about a
comparison a copy and hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, scope, text_or_empty, trimmed, written
from .components import components
from .jaccard import _set_of, _zipped, shingle_set

PERCENT = 85
#: A pair at the threshold meets in no band with probability (1 - 0.85 ** 8) ** 48 < 3e-7.
BANDS, ROWS = 48, 8
SAMPLES = BANDS * ROWS
BITS = 1024  # of each bitmap
#: Standard deviations by which an estimate may fall short of the threshold: samples vary by sqrt(t (1 - t) / 384) = 0.018, bitmaps by less.
MARGIN = 6
UNIT = 512  # nodes of a unit

_rng = np.random.default_rng(20240517)
FACTORS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def samples_of(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes: for each of the hash functions the least value."""
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(low), 512):
        values = np.multiply.outer(FACTORS, low[i : i + 512])
        values += SHIFTS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _parity(values: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount(values % BITS, minlength=BITS) & 1).astype(bool))


def sketch_of(samples: np.ndarray, s: np.ndarray) -> bytes:
    """Two parity bitmaps: of the samples with their places, and of the set itself."""
    placed = _mixed32(samples + np.arange(SAMPLES, dtype=np.uint32) * np.uint32(0x9E3779B9))
    return np.r_[_parity(placed), _parity(s)].tobytes()


def bands_of(samples: np.ndarray) -> list[int]:
    """A 64-bit value for each band."""
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=b) - (1 << 63) for b, row in enumerate(samples.reshape(BANDS, ROWS))]


def estimate(differ: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the number of bits in which two bitmaps of samples differ."""
    share = np.minimum(2 * np.asarray(differ, np.float64) / BITS, 1 - 1e-9)
    return 1 + BITS * np.log1p(-share) / (4 * SAMPLES)


#: Most differing bits of the bitmaps of samples that may go with a link.
T = PERCENT / 100
DIFFER_MOST = int(np.searchsorted(-estimate(np.arange(BITS // 2)), -(T - MARGIN * (T * (1 - T) / SAMPLES) ** 0.5), "right"))


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sizes and both bitmaps (rows of 64-bit words) allow a link."""
    words = BITS // 64
    apart = np.bitwise_count(a ^ b)
    sampled, exact = apart[..., :words].sum(-1, dtype=np.int64), apart[..., words:].sum(-1, dtype=np.int64)
    # |A - B| + |B - A| is at most (1 - t) / (1 + t) of both sizes together
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (sampled <= DIFFER_MOST) & (exact * (100 + PERCENT) <= (100 - PERCENT) * (n + m))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _maps(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2 * BITS // 64)


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, node, n; and packed text, sketch and bands where the node is new in this task."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    names, kinds = ["doc", "node", "n", "packed", "sketch", "bands"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    s = shingle_set(raw)
                    node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    if node is None or node in seen:
                        rows.append((doc, node, len(s), None, None, None))
                        continue
                    seen.add(node)
                    samples = samples_of(s)
                    rows.append((doc, node, len(s), _zipped(raw), sketch_of(samples, s), bands_of(samples)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return written(src.mapInArrow(lambda batches: trimmed(run(batches)), "doc long, node long, n long, packed binary, sketch binary, bands array<long>"))


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, node of the pairs whose sizes and bitmaps allow a link."""
    for b in batches:
        if b.num_rows:
            ok = may_link(_maps(b.column("sketch")), _maps(b.column("hub_sketch")), b.column("n").to_numpy(), b.column("hub_n").to_numpy())
            yield b.select(["hub", "node"]).filter(pa.array(ok))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs that are linked on their full sets; pairs come sorted by hub."""
    last, kept = None, np.zeros(0, np.uint64)
    for batch in batches:
        yes = []
        for hub, text, other in zip(batch.column("hub").to_pylist(), batch.column("hub_packed").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if hub != last:
                last, kept = hub, _set_of(text)
            yes.append(linked(kept, _set_of(other)))
        ok = batch.filter(pa.array(yes, pa.bool_()))
        yield pa.RecordBatch.from_arrays([ok.column("hub"), ok.column("node")], ["a", "b"])


def _across(table: pa.Table) -> pa.Table:
    """Links between nodes of different components in one unit, up to connection; side 0 against side 1 (or 2: all)."""
    order = np.lexsort((table["node"].to_numpy(), table["n"].to_numpy()))
    node, n, side, comp = (table[c].to_numpy()[order] for c in ("node", "n", "side", "comp"))
    maps = _maps(table["sketch"])[order]
    packed, sets = table["packed"], {}
    group = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    def of(i: int) -> np.ndarray:
        if i not in sets:
            if len(sets) >= 2 * UNIT:
                sets.clear()
            sets[i] = _set_of(packed[int(order[i])].as_py())
        return sets[i]

    out = []
    for i in range(len(node)):
        js = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // PERCENT, "right")))
        js = js[(comp[js] != comp[i]) & ((side[js] != side[i]) | (side[i] == 2))]
        js = js[may_link(maps[js], maps[i], n[js], n[i])]
        for j in js.tolist():
            if root(int(comp[i])) != root(int(comp[j])) and linked(of(i), of(j)):
                group[root(int(comp[i]))] = root(int(comp[j]))
                out.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _rest(met: DataFrame, held: DataFrame, root: DataFrame, unit: int) -> DataFrame:
    """Links between nodes that share a hub and are in different components.

    Nodes of one hub are cut into blocks of about unit nodes: a component of more nodes has blocks of its own, which
    aren't compared with each other; the others share blocks. Every two other blocks make a unit, and every block of
    mixed components one of itself.
    """
    members = met.join(root.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    hubs = members.groupBy("hub").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("hub")
    # written, so that both sides come by an exchange and Spark splits the rows of a large group's hub
    members = written(members.join(written(hubs), "hub", "left_semi"))
    sizes = members.groupBy("hub", "comp").agg(F.count("*").alias("size"))
    own = sizes.withColumn("own", F.when(F.col("size") > unit, F.col("comp")))
    parts = written(own.groupBy("hub", "own").agg(F.sum("size").alias("size")).select("hub", "own", F.ceil(F.col("size") / unit).cast("int").alias("parts")))
    large = written(own.where("own is not null").select("hub", "comp"))
    block = lambda k: parts.select("hub", F.col("own").alias(f"o{k}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"p{k}"))
    first = F.struct(F.coalesce("o1", F.lit(0)).alias("o"), F.col("o1").isNull().alias("m"), F.col("p1").alias("p"))
    second = F.struct(F.coalesce("o2", F.lit(0)).alias("o"), F.col("o2").isNull().alias("m"), F.col("p2").alias("p"))
    # blocks of one large component have no links to look for between them
    units = block(1).join(block(2), "hub").where((first < second) & (F.col("o1").isNull() | F.col("o2").isNull() | (F.col("o1") != F.col("o2"))) | ((first == second) & F.col("o1").isNull()))
    side = lambda k, s: F.struct(F.col(f"o{k}").alias("own"), F.col(f"p{k}").alias("part"), s.alias("side"))
    same = first == second
    sides = units.select("hub", "o1", "p1", "o2", "p2", F.explode(F.when(same, F.array(side(1, F.lit(2)))).otherwise(F.array(side(1, F.lit(0)), side(2, F.lit(1))))).alias("s")).select("hub", "o1", "p1", "o2", "p2", F.coalesce("s.own", F.lit(0)).alias("own"), F.col("s.own").isNotNull().alias("is_own"), "s.part", "s.side")
    placed = members.join(large.withColumn("is_own", F.lit(True)), ["hub", "comp"], "left").withColumn("is_own", F.coalesce("is_own", F.lit(False))).withColumn("own", F.when(F.col("is_own"), F.col("comp")).otherwise(F.lit(0)))
    counted = parts.select("hub", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNotNull().alias("is_own"), "parts")
    placed = placed.join(counted, ["hub", "own", "is_own"]).select("hub", "node", "comp", "own", "is_own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    rows = placed.join(sides, ["hub", "own", "is_own", "part"]).join(held, "node")
    keys = ["hub", "o1", "p1", "o2", "p2"]
    return rows.select(*keys, "side", "comp", "node", "n", "sketch", "packed").groupBy(*keys).applyInArrow(_across, "a long, b long")


def sketched_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """A row for each document: id_col (long), n_shingles, component_id, kept.

    Linked documents have 100 * intersection >= 85 * union of their sets of 5-word shingles; component_id is the smallest id
    reachable by links, the document's own included, and kept says whether it is the document's own. Links are confirmed on full
    sets; only connection is computed, not each link. A link is lost only if its sets meet in no band, or the
    estimate falls short by over MARGIN standard deviations.

    Texts of fewer words are one shingle; null, empty or blank texts have none, no links, and are kept. Repeated rows are
    documents with equal sets; rows that repeat the smallest id are all kept. A null id stays null, takes the component of its set, and
    isn't kept where another document has an id. Ids that aren't numbers must be given as such; other columns are
    ignored; an empty table gives no rows. unit bounds a task's work, results don't depend on it.
    """
    with scope(docs.sparkSession):
        return lasting(_sketched(docs, id_col, text_col, unit))


def _sketched(docs: DataFrame, id_col: str, text_col: str, unit: int) -> DataFrame:
    each = _nodes(docs, id_col, text_col)
    fresh = each.where("sketch is not null")
    banded = fresh.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").select("band", "hub")
    # written, so that both sides of the join come by an exchange, which Spark splits where a band value is frequent
    met = written(banded.join(written(hubs), "band").where("node <> hub").select("hub", "node").distinct())
    wanted = written(met.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
    held = written(fresh.select("node", "n", "sketch", "packed").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("packed").alias("packed")))
    as_hub = held.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"), F.col("packed").alias("hub_packed"))
    maps = met.join(held.select("node", "n", "sketch"), "node").join(as_hub.select("hub", "hub_n", "hub_sketch"), "hub")
    near = written(maps.mapInArrow(_passing, "hub long, node long"))
    texts = near.join(held.select("node", "packed"), "node").join(as_hub.select("hub", "hub_packed"), "hub").sortWithinPartitions("hub")
    links = written(texts.mapInArrow(lambda batches: trimmed(_confirmed(batches)), "a long, b long"))
    links = links.unionByName(_rest(met, held, components(links, "a", "b"), unit))

    ids = written(each.where("node is not null").groupBy("node").agg(F.min("doc").alias("least")))
    root = components(links, "a", "b")
    best = root.join(ids, "node").groupBy("root").agg(F.min("least").alias("component"))
    of_node = written(ids.join(root.join(best, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "least").alias("component_id")))
    done = each.where("node is not null").select("doc", "node", "n").join(of_node, "node").select("doc", "n", "component_id")
    done = done.unionByName(each.where("node is null").select("doc", "n", F.col("doc").alias("component_id")))
    return done.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.equal_null("doc", "component_id").alias("kept"))
