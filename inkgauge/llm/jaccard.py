"""Similarity join of documents by the Jaccard measure of their word shingles: a size-aware heavy-light join.

A node is a distinct shingle set; equal sets are one node with many documents. All sets keep their shingles in one order:
those of one node alone first, then by the number of nodes that hold them. Two linked sets share a shingle among each
one's first n - ceil(t n) + 1, and k shingles among the first n - ceil(t n) + k. Shingles of one node alone are shared
with none, so a node whose first shingles are all its own has no links and goes no further. Light sets enumerate all
pairs of their first shingles and meet in a pair; heavy sets, and light ones large enough to be linked to a heavy one,
are entered into inverted lists of single shingles. The boundary between light and heavy is the size that costs least by
the histogram of sizes.

How many nodes hold a shingle is counted for all shingles: packed hashes meet in buckets, and only shingles of several
nodes come back. The commonest are counted beforehand and known to every task, so that no shingle fills a bucket.

The lists aren't expanded into all pairs. A list is cut where sizes leave a gap that no link can cross. Each list has a hub, its smallest node; every other node of the list is
compared with the hub. All nodes that met one hub form its canopy, and any two nodes that share a list are in the
canopy of that list's hub. Inside a canopy, nodes linked to the hub are connected already; the others are compared with
those whose distance from the hub allows a link by the triangle inequality. So all links are found up to connection,
and a large group of near copies costs one comparison a copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, lasting, scope, semi_join, text_or_empty, trimmed, written
from .components import components

#: Odd multipliers, one for each word of a shingle; fixed values.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
WIDTH = 5
PERCENT = 80
LIST_COST = 4.0  # of an entry in an inverted list, against an enumerated pair
COMMON_HERE, COMMON_MOST = 4, 1 << 18  # documents of a batch that make a shingle common; common shingles kept
ENTRIES = 400_000  # of inverted lists in a bucket, about
COUNTED = 1 << 20  # shingles in a bucket that counts them, about
CHUNK = 1 << 19  # shingles of the nodes that a task sends together, about


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WIDTH, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += h[i : i + n] * MULTIPLIERS[i]
    return np.unique(mixed(s))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it is linked to."""
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Whether two sorted sets are linked, and their Jaccard distance."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    union = len(a) + len(b) - both
    return 100 * both >= PERCENT * union, 1 - both / union


def may_link(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    """Whether sizes allow a link."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def boundary(costs: dict[int, tuple[float, float]]) -> int:
    """Largest size of a light set, so that enumerated pairs and weighted list entries (given by size) cost least together."""
    n = np.array(sorted(costs), np.int64)
    if not len(n):
        return 0
    light, heavy = np.array([costs[i] for i in n.tolist()], np.float64).T
    pairs, lists = np.concatenate([[0], np.cumsum(light)]), np.concatenate([[0], np.cumsum(LIST_COST * heavy)])
    cuts = np.concatenate([[0], n])
    from_ = np.searchsorted(n, (PERCENT * cuts + 99) // 100, "left")
    cost = pairs + lists[-1] - np.where(cuts > 0, lists[from_], 0)
    return int(cuts[int(np.argmin(cost))])


def signatures(n: int, head: np.ndarray, cut: int, light_most: int) -> np.ndarray:
    """Keys of the lists that a set of n shingles enters; head are its first shared ones, cut how many lists of single shingles take."""
    out = []
    if n <= light_most and n > 1:
        i, j = np.triu_indices(len(head), 1)
        out.append(mixed(np.minimum(head[i], head[j]) * MULTIPLIERS[0] + np.maximum(head[i], head[j]) * MULTIPLIERS[1]))
    if n > light_most or may_link(n, light_most + 1):
        out.append(mixed(head[:cut]))
    return np.concatenate(out) if out else head[:0]


def _zipped(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _unzipped(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _set_of(packed: bytes) -> np.ndarray:
    return shingle_set(_unzipped(packed))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind 0: doc, node, n, and packed text and uid where the node is new in this task; kind 1: common shingle (node) and documents (n)."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            node, size, packed, uid, fresh = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                s = shingle_set(raw)
                k = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                node.append(k)
                size.append(len(s))
                new = k is not None and k not in seen
                packed.append(_zipped(raw) if new else None)
                uid.append(base + len(seen) if new else None)
                if new:
                    seen.add(k)
                    fresh.append(s)
            rows = len(node)
            keys, df = np.unique(np.concatenate(fresh) if fresh else np.zeros(0, np.uint64), return_counts=True)
            keys, df = keys[df >= COMMON_HERE], df[df >= COMMON_HERE]
            more = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.zeros(rows, np.int32), np.ones(more, np.int32)]),
                    pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(more, pa.int64())]),
                    pa.array([*node, *keys.view(np.int64).tolist()], pa.int64()),
                    pa.array([*size, *df.tolist()], pa.int64()),
                    pa.array([*packed, *[None] * more], pa.binary()),
                    pa.array([*uid, *[None] * more], pa.int64()),
                ],
                ["kind", "doc", "node", "n", "packed", "uid"],
            )

    return written(src.mapInArrow(lambda batches: trimmed(run(batches)), "kind int, doc long, node long, n long, packed binary, uid long"))


def _once(nodes: DataFrame) -> DataFrame:
    """node, n, packed: each node of more than one shingle, from the task with the least uid."""
    new = nodes.where("kind = 0 and uid is not null and n > 1")
    again = written(new.groupBy("node").agg(F.min("uid").alias("least"), F.count("*").alias("tasks")).where("tasks > 1").select("node", "least"))
    if again.limit(FEW + 1).count() <= FEW:
        return new.join(F.broadcast(again), "node", "left").where("least is null or least = uid").select("uid", "node", "n", "packed")
    # written: chunks are cut and named by the order of rows, which a shuffle doesn't keep when a task runs again
    return written(semi_join(new, new.groupBy("node").agg(F.min("uid").alias("uid")), "uid").select("uid", "node", "n", "packed"))


def _heads(once: DataFrame, buckets: int, common) -> DataFrame:
    """node, n, head (keys, packed), cut: of each node that may have links, its first shared shingles in the common order.

    Chunks of nodes send 32 bits of each shingle to the bucket that its other bits choose. A bucket counts the nodes of
    each and sends back those of several, with the count; a node's other shingles are its own. Two shingles that fall
    together count as shared and as one key, which makes candidates, never loses any. Common shingles aren't sent.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weight = common.value
        held: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        uid, total = 0, 0

        def out() -> pa.RecordBatch:
            chunk = uid
            flat, who = np.concatenate(held), np.repeat(np.arange(len(held)), sizes).astype(np.uint16)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            is_common = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            where = np.flatnonzero(is_common)
            where = where[np.lexsort((flat[where], weight[at[where]], who[where]))] if len(where) else where
            many = np.bincount(who[where], minlength=len(held))
            place = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
            n = np.array(sizes)
            most = n - (PERCENT * n + 99) // 100 + 2
            where = where[place < most[who[where]]]
            rows = [(chunk % buckets, chunk, True, np.array(nodes, np.int64).tobytes(), n.astype("<i4").tobytes(), many.astype("<i4").tobytes(), who[where].tobytes(), flat[where].tobytes())]
            flat, who = flat[~is_common], who[~is_common]
            bucket = (flat >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            flat, who, bucket = flat[order].astype(np.uint32), who[order], bucket[order].astype(np.int64)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                rows.append((int(bucket[i]), chunk, False, _zipped(np.diff(who[i:j], prepend=np.uint16(0)).tobytes()), flat[i:j].tobytes(), None, None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5))], PACKS)

        for batch in batches:
            for number, node, packed in zip(batch.column("uid").to_pylist(), batch.column("node").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                s = _set_of(packed)
                if held and (total + len(s) > CHUNK or len(held) == 60_000):
                    yield out()
                    held, nodes, sizes, total = [], [], [], 0
                if not held:
                    uid = number
                held.append(s)
                nodes.append(node)
                sizes.append(len(s))
                total += len(s)
        if held:
            yield out()

    def counted(table: pa.Table) -> pa.Table:
        """The rows of chunks as they are; of each chunk's shingles in this bucket those that other nodes hold too, with their number of nodes."""
        meta = np.array(table["meta"].to_pylist(), bool)
        keep = table.filter(pa.array(meta))
        rest = table.filter(pa.array(~meta))
        key = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x, np.uint32) for x in rest["b"].to_pylist()]])
        who = np.concatenate([np.zeros(0, np.uint16), *[np.cumsum(np.frombuffer(_unzipped(x), np.uint16), dtype=np.uint16) for x in rest["a"].to_pylist()]])
        row = np.repeat(np.arange(rest.num_rows), [len(x) // 4 for x in rest["b"].to_pylist()])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        head = np.r_[True, ordered[1:] != ordered[:-1]][: len(key)]
        length = np.diff(np.r_[np.flatnonzero(head), len(key)])
        df = np.repeat(length, length)
        several = df > 1
        at, df = order[several], df[several]
        by = np.argsort(at)
        at, df = at[by], df[by]
        edges = np.searchsorted(row[at], np.arange(rest.num_rows + 1))
        out = []
        for r, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if i < j:
                out.append((table["bucket"][0].as_py(), rest["chunk"][r].as_py(), False, _zipped(np.diff(who[at[i:j]], prepend=np.uint16(0)).tobytes()), key[at[i:j]].tobytes(), _zipped(df[i:j].astype("<i4").tobytes()), None, None))
        return pa.concat_tables([keep, pa.table([pa.array([r[k] for r in out], keep.schema.field(k).type) for k in range(8)], schema=keep.schema)])

    def ordered(table: pa.Table) -> pa.Table:
        """Heads of one chunk's nodes."""
        meta = table["meta"].to_pylist()
        m = table.slice(meta.index(True), 1).to_pylist()[0]
        node, n, commons = np.frombuffer(m["a"], np.int64), np.frombuffer(m["b"], "<i4").astype(np.int64), np.frombuffer(m["c"], "<i4")
        who, key, df = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for own, bucket, a, b, c in zip(meta, *(table[x].to_pylist() for x in ("bucket", "a", "b", "c")), strict=True):
            if not own:
                who.append(np.cumsum(np.frombuffer(_unzipped(a), np.uint16), dtype=np.uint16))
                key.append(np.uint64(bucket << 32) | np.frombuffer(b, np.uint32))
                df.append(np.frombuffer(_unzipped(c), "<i4"))
        who, key, df = np.concatenate(who), np.concatenate(key), np.concatenate(df)
        several = np.bincount(who, minlength=len(node))
        alone = n - commons - several
        first = n - (PERCENT * n + 99) // 100 + 1
        alive = alone < first
        keep = alive[who]
        order = np.flatnonzero(keep)[np.lexsort((key[keep], df[keep], who[keep]))]
        whose = np.frombuffer(m["d"], np.uint16)
        keep = alive[whose]
        # common ones follow, in the order they came in; the sort is stable
        whose = np.r_[who[order], whose[keep]]
        keys = np.r_[key[order], np.frombuffer(m["e"], np.uint64)[keep]]
        keys = keys[np.argsort(whose, kind="stable")]
        edges = np.r_[0, np.cumsum(np.bincount(whose, minlength=len(node)))]
        out = []
        for i in np.flatnonzero(alive).tolist():
            left = int(first[i] - alone[i])
            head = keys[edges[i] : min(edges[i + 1], edges[i] + left + 1)]
            out.append((int(node[i]), int(n[i]), head.tobytes(), min(left, len(head)), len(head)))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["node", "n", "head", "cut", "held"])

    packs = "bucket int, chunk long, meta boolean, a binary, b binary, c binary, d binary, e binary"
    several = once.mapInArrow(lambda batches: trimmed(sent(batches)), packs).groupBy("bucket").applyInArrow(counted, packs)
    return written(several.groupBy("chunk").applyInArrow(ordered, "node long, n long, head binary, cut int, held int"))


PACKS = ["bucket", "chunk", "meta", "a", "b", "c", "d", "e"]


def segments(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where segments begin, of entries sorted by key and low: a list falls apart where no sizes across a gap can link."""
    if not len(key):
        return np.zeros(0, bool)
    head = np.r_[True, key[1:] != key[:-1]]
    lift = np.cumsum(head) << np.int64(34)
    reach = (np.maximum.accumulate(lift + high) - lift)[:-1]
    return head | np.r_[True, PERCENT * low[1:].astype(np.int64) > 100 * reach]


def _canopies(heads: DataFrame, buckets: int, light_most: int, hot: int) -> DataFrame:
    """hub, node, n: each node with the hub of each list it is in.

    A list is cut where neighbouring sizes are too far apart for a link; what is between cuts is a list of its own below.
    Entries meet in buckets of keys. Where a batch of documents alone has over hot nodes in a list, only the smallest of
    them goes to the bucket, with the range of sizes; the others are spread over buckets of their own and tied to the
    list's hub by a join on the key, which Spark splits where a key is frequent. So a list of a third of all nodes fills
    no bucket. Keys keep 40 bits within a bucket; two keys that fall together only make a canopy larger.
    """
    low_bits = np.uint64((1 << 40) - 1)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            made = [signatures(n, np.frombuffer(h, np.uint64), cut, light_most) for n, h, cut in zip(sizes.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            key, who = np.concatenate([np.zeros(0, np.uint64), *made]), np.repeat(np.arange(len(made)), [len(m) for m in made])
            if not len(key):
                continue
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            key = (bucket.astype(np.uint64) << np.uint64(40)) | (key & low_bits)
            order = np.lexsort((ids[who], sizes[who], key))
            key, node, n, bucket = key[order], ids[who[order]], sizes[who[order]], bucket[order]
            starts = np.flatnonzero(segments(key, n, n))
            length = np.diff(np.r_[starts, len(key)])
            hub = np.repeat(np.minimum.reduceat(node, starts), length)
            frequent = np.repeat(length > hot, length)
            low, high = np.repeat(n[starts], length), np.repeat(np.maximum.reduceat(n, starts), length)
            aside = frequent & (node != hub)
            bucket[aside] = buckets + node[aside] % buckets
            order = np.lexsort((node, bucket))  # equal nodes side by side compress well
            key, node, n, bucket, frequent, low, high = (x[order] for x in (key, node, n, bucket, frequent, low, high))
            edges = np.searchsorted(bucket, np.arange(2 * buckets + 1))
            rows = []
            for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                if i < j:
                    f = frequent[i:j]
                    k = key[i:j].view(np.uint8).reshape(-1, 8)
                    spans = b"" if b >= buckets else np.c_[low[i:j][f], high[i:j][f]].astype(np.int64).tobytes()
                    rows.append((b, (k if b >= buckets else k[:, :5]).tobytes(), node[i:j].tobytes(), n[i:j].astype(np.int32).tobytes(), f.tobytes(), spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]], ["bucket", "keys", "ids", "sizes", "frequent", "spans"])

    def meet(table: pa.Table) -> pa.Table:
        """kind 0: node tied to its hub; 1: hub and sizes of a frequent list; 2: node of a frequent list, with the list's key."""
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
        node, n, frequent = read("ids", np.int64), read("sizes", np.int32).astype(np.int64), read("frequent", bool)
        bucket = table["bucket"][0].as_py()

        def out(kind: int, key: np.ndarray, hub: np.ndarray, node: np.ndarray, n: np.ndarray, high: np.ndarray) -> pa.Table:
            return pa.table({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key.view(np.int64)), "hub": pa.array(hub), "node": pa.array(node), "n": pa.array(n), "high": pa.array(high)})

        if bucket >= buckets:
            return out(2, read("keys", np.uint64), node, node, n, n)
        raw = np.zeros((len(node), 8), np.uint8)
        raw[:, :5] = read("keys", np.uint8).reshape(-1, 5)
        key = raw.view(np.uint64).ravel()
        low, high = n.copy(), n.copy()
        low[frequent], high[frequent] = read("spans", np.int64).reshape(-1, 2).T
        order = np.lexsort((low, key))
        key, node, n, frequent, low, high = (x[order] for x in (key, node, n, frequent, low, high))
        starts = np.flatnonzero(segments(key, low, high))
        length = np.diff(np.r_[starts, len(key)])
        least = np.minimum.reduceat(node, starts)
        hub = np.repeat(least, length)
        tied = np.flatnonzero(node != hub)
        once = np.unique(np.c_[hub[tied], node[tied]], axis=0, return_index=True)[1] if len(tied) else tied
        tied = tied[once]
        marked = np.maximum.reduceat(frequent, starts)
        full = (np.uint64(bucket) << np.uint64(40)) | key[starts][marked]
        return pa.concat_tables([out(0, np.zeros(len(tied), np.uint64), hub[tied], node[tied], n[tied], n[tied]), out(1, full, least[marked], least[marked], low[starts][marked], np.maximum.reduceat(high, starts)[marked])])

    packs = heads.select("node", "n", "head", "cut").mapInArrow(entries, "bucket int, keys binary, ids binary, sizes binary, frequent binary, spans binary")
    met = written(packs.groupBy("bucket").applyInArrow(meet, "kind int, key long, hub long, node long, n long, high long"))
    hubs = met.where("kind = 1").select("key", "hub", F.col("n").alias("low"), "high")
    frequent = met.where("kind = 2").select("key", "node", "n").join(hubs, "key").where("hub <> node and n >= low and n <= high")
    return written(met.where("kind = 0").select("hub", "node", "n").unionByName(frequent.select("hub", "node", "n")).distinct())


def _compare(pairs: DataFrame) -> DataFrame:
    """hub, node, n, packed, distance, link for pairs that hold both packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for b in batches:
            link, far = [], []
            for hub, text, other in zip(b.column("hub").to_pylist(), b.column("packed_hub").to_pylist(), b.column("packed").to_pylist(), strict=True):
                if hub != last:
                    last, kept = hub, _set_of(text)
                yes, d = linked(kept, _set_of(other))
                link.append(yes)
                far.append(d)
            yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("node"), b.column("n"), pa.array(far, pa.float64()), pa.array(link, pa.bool_())], ["hub", "node", "n", "distance", "link"])

    return pairs.select("hub", "node", "n", "packed_hub", "packed").mapInArrow(run, "hub long, node long, n long, distance double, link boolean")


def _within(table: pa.Table) -> pa.Table:
    """Links between the nodes of one unit of a canopy, up to connection; side 0 against side 1 (or 2: both)."""
    node, side, n, d = (table[c].to_numpy() for c in ("node", "side", "n", "distance"))
    order = np.lexsort((node, n))
    node, side, n, d = node[order], side[order], n[order], d[order]
    packed = [table["packed"][int(i)].as_py() for i in order]
    near = 1 - PERCENT / 100 + 1e-9
    group = {int(i): int(i) for i in range(len(node))}
    sets: dict[int, np.ndarray] = {}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = _set_of(packed[i])
        return sets[i]

    hub_linked = d <= near
    maps: dict[int, np.ndarray] = {}

    def bitmap(i: int) -> np.ndarray:
        """1024 bits of a set; those in which two bitmaps differ stand for different elements of their difference."""
        if i not in maps:
            m = np.zeros(1024, bool)
            m[of(i) & np.uint64(1023)] = True
            maps[i] = np.packbits(m).view(np.uint64)
        return maps[i]

    out = []
    for i in range(len(node)):
        stop = int(np.searchsorted(n, n[i] * 100 // PERCENT, "right"))
        js = np.arange(i + 1, stop)
        js = js[(np.abs(d[js] - d[i]) <= near) & ~(hub_linked[js] & hub_linked[i]) & ((side[js] != side[i]) | (side[i] == 2))]
        if not len(js):
            continue
        differ = np.bitwise_count(np.array([bitmap(j) for j in js.tolist()]) ^ bitmap(i)).sum(1)
        # |A - B| + |B - A| is at most (1 - t) / (1 + t) of both sizes together
        js = js[differ * (100 + PERCENT) <= (100 - PERCENT) * (n[i] + n[js])]
        for j in js.tolist():
            if root(i) != root(j) and linked(of(i), of(j))[0]:
                group[root(i)] = root(j)
                out.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _units(members: DataFrame, texts: DataFrame, unit: int) -> DataFrame:
    """Links within canopies, up to connection.

    A canopy of more than unit nodes is cut into blocks of about unit nodes, by bands of half the link distance from the
    hub (bands 0 and 1: linked to it) and by hash. Two blocks are compared if their bands are at most 3 apart, which
    the triangle inequality allows for, and not both linked. A canopy without nodes apart from its hub needs nothing.
    """
    step = (100 - PERCENT) / 200
    raw = F.floor(F.col("distance") / step)
    members = members.withColumn("band", F.when(F.col("link"), F.least(raw, F.lit(1))).otherwise(F.least(F.greatest(raw, F.lit(2)), F.lit(9))).cast("int"))
    hubs = members.groupBy("hub").agg(F.count("*").alias("nodes"), F.sum((~F.col("link")).cast("long")).alias("apart")).where("apart > 0 and nodes > 1").select("hub", (F.col("nodes") <= unit).alias("one"))
    held = members.groupBy("hub", "band").agg(F.count("*").alias("held")).join(hubs, "hub")
    bands = held.select("hub", "band", "one", F.when(F.col("one"), F.lit(1)).otherwise(F.ceil(F.col("held") / unit)).cast("int").alias("parts"))
    block = F.when(F.col("one"), F.lit(0)).otherwise(F.col("band"))
    blocks = bands.select("hub", block.alias("b1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p1")).distinct()
    others = blocks.select("hub", F.col("b1").alias("b2"), F.col("p1").alias("p2"))
    pairs = blocks.join(others, "hub").where("(b1 < b2 or (b1 = b2 and p1 <= p2)) and b2 - b1 <= 3 and (b2 > 1 or (b1 = 0 and p1 = 0 and b2 = 0 and p2 = 0))")
    side = lambda b, p, k: F.struct(F.col(b).alias("block"), F.col(p).alias("part"), F.lit(k).alias("side"))
    same = (F.col("b1") == F.col("b2")) & (F.col("p1") == F.col("p2"))
    sides = pairs.select("hub", "b1", "p1", "b2", "p2", F.explode(F.when(same, F.array(side("b1", "p1", 2))).otherwise(F.array(side("b1", "p1", 0), side("b2", "p2", 1)))).alias("s")).select("hub", "b1", "p1", "b2", "p2", "s.block", "s.part", "s.side")
    placed = members.join(bands, ["hub", "band"]).select("hub", "node", "n", "distance", block.alias("block"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    rows = placed.join(sides, ["hub", "block", "part"]).join(texts, "node")
    return rows.select("hub", "b1", "p1", "b2", "p2", "node", "side", "n", "distance", "packed").groupBy("hub", "b1", "p1", "b2", "p2").applyInArrow(_within, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 512, hot: int = 64, light_most: int | None = None) -> DataFrame:
    """A row for each document: id_col (long; ids of other types must be numbers, what isn't one becomes null), n_shingles, component_id.

    Linked documents have 100 * intersection >= 80 * union of their sets of 5-word shingles; component_id is the
    smallest id reachable by links, the document's own included. Only connection is computed: pairs already
    connected aren't compared, and links aren't counted. Texts of fewer words are one shingle; null, empty or
    blank texts have none and no links. Repeated rows are documents with equal sets. A null id stays null and takes the
    component of its set. Other columns are ignored; an empty table gives no rows. light_most overrides the boundary
    chosen by cost; unit and hot bound a task's work, results don't depend on them.
    """
    with scope(docs.sparkSession):
        return lasting(_near_duplicates(docs, id_col, text_col, unit, hot, light_most))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, unit: int, hot: int, light_most: int | None) -> DataFrame:
    nodes = _nodes(docs, id_col, text_col)
    each = nodes.where("kind = 0")
    top = nodes.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(COMMON_MOST).toArrow()
    key = top["node"].to_numpy().view(np.uint64) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    common = docs.sparkSession.sparkContext.broadcast((key[order], top["n"].to_numpy()[order] if len(top) else np.zeros(0, np.int64)))
    shingles = each.where("uid is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heads = _heads(_once(nodes), max(8, math.ceil(shingles / COUNTED)), common)
    # n is at most the words of one text; sums by size are what the driver needs to choose the boundary
    scale = F.when(F.col("n") <= 256, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n")) * 8) / 8).cast("long"))
    costs = {r[0]: (r[1], r[2]) for r in heads.groupBy(scale).agg(F.sum(F.col("held") * (F.col("held") - 1) / 2), F.sum("cut").cast("double")).collect()}
    entries = sum(lists for _, lists in costs.values())
    met = _canopies(heads, max(16, math.ceil(entries / ENTRIES)), boundary(costs) if light_most is None else light_most, hot)

    wanted = written(met.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
    texts = written(semi_join(each.where("packed is not null").select("node", "packed"), wanted, "node").groupBy("node").agg(F.min("packed").alias("packed")))
    hubs = texts.select(F.col("node").alias("hub"), F.col("packed").alias("packed_hub"))
    measured = written(_compare(met.join(texts, "node").join(hubs, "hub").sortWithinPartitions("hub")))
    links = measured.where("link").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    edges = links.unionByName(_units(measured, texts, unit))

    ids = written(each.where("node is not null").groupBy("node").agg(F.min("doc").alias("least")))
    root = components(edges, "a", "b")
    best = root.join(ids, "node").groupBy("root").agg(F.min("least").alias("component"))
    # written: a set that many documents hold is a hot key, whose rows Spark splits where both sides come by an exchange
    of_node = written(ids.join(root.join(best, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "least").alias("component")))
    done = each.where("node is not null").select("doc", "node", "n").join(of_node, "node").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return done.unionByName(each.where("node is null").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id")))
