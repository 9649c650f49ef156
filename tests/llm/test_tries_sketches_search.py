"""Prefix tries, lexical search and odd sketches against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import jaccard, lexical, odd_sketch
from inkgauge.llm.prefix_trie import prefix_trie

AWKWARD = [(1, None), (2, ""), (3, "   \n"), (3, "twice the id"), (None, "no id"), (4, "same text"), (4, "same text"), (5, "x" * 20000), (6, "Ünïcödé 漢字 🙂 don't\t\x1c\x85 a  b\n\n c")]


def trie(rows):
    conv, members, ends, children, out = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list), {}
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        seq = conv.get(c - int(math.fmod(c, 5)), [])[:h] + conv[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in children[n]) if children[n] else 1
        saved = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(out[k][6] for k in children[n])
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
        out[n] = (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves, saved, digest)
    return Counter(out.values())


def test_op11(spark):
    """Nulls, ties, repeated rows, negative ids, conversations without turns of their own, and two long ones that share a hundred turns."""
    rng, rows = random.Random(1), []
    for c in [*range(-7, 60), None]:
        rows += [(c, rng.choice([None, t]), rng.choice([None, "u", "a"]), rng.choice([None, "", "hi", "hé"])) for t in range(rng.choice([0, 1, 2, 3, 8, 12, 20]))]
    rows += rows[:20]
    rows += [(c, t, "u", "hi" if t < 100 else f"hi {c}") for c in (1000, 1001) for t in range(150)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(5)
    assert Counter(map(tuple, prefix_trie(df).collect())) == trie(rows)
    assert prefix_trie(df.limit(0)).collect() == []
    assert prefix_trie(df.where("conv_id is null")).collect() == []


def test_op11_parts(spark):
    """One conversation holds most turns and spans parts; many conversations are copies, so that most ends meet in one node."""
    rows = [(3, t, "u", f"t{t}") for t in range(400)] + [(5 * i, t, "u", f"same {t}") for i in range(2, 120) for t in range(3)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(map(tuple, prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == trie(rows)


def ranking(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length if length else 0
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, times in Counter(terms(text)).items() if w in c)
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("vocabulary_bytes", [1 << 26, 0])
def test_op12(spark, monkeypatch, vocabulary_bytes):
    """Small blocks, ties, repeated ids, rows without texts; with terms that every task knows and with those that are joined."""
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", vocabulary_bytes)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "é", "É", "漢字", "7", "x1", "the", "the", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) + rng.choice(["", ".", "_", "\x1c!"])) for i in range(120)] + AWKWARD + [(200, "the " * 30000)]
    items = [(1, "alpha, the the 漢字"), (2, "Beta beta É"), (2, "gamma"), (3, None), (None, "x1 same"), (4, "nowhere")]
    ddf = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, block int, score string").repartition(3)
    idf = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    assert Counter(map(tuple, lexical.lexical_search(ddf, idf).collect())) == ranking(docs, items)
    assert lexical.lexical_search(ddf.limit(0), idf).collect() == [] == lexical.lexical_search(ddf, idf.limit(0)).collect()


def families(rows, percent=85):
    sets = [set(jaccard.shingle_set((t or "").encode()).tolist()) for _, t in rows]
    group, lists = list(range(len(rows))), defaultdict(list)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        both = Counter(j for h in a for j in lists[h])
        for h in a:
            lists[h].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(a) + len(sets[j]) - k):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i)), least.get(root(i)) == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("unit", [4, 512])
def test_op13(spark, unit):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 15, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(500):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) if i % 50 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, odd_sketch.sketched_duplicates(df, unit=unit).collect())) == families(rows)


def test_op13_chain(spark):
    """Near the threshold: each text is linked to the next few only, so that hubs leave several components to be joined."""
    rng = random.Random(6)
    w, rows = [f"w{rng.randrange(10**6)}" for _ in range(400)], []
    for i in range(150):
        for _ in range(3):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert Counter(map(tuple, odd_sketch.sketched_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), unit=16).collect())) == families(rows)


def test_op13_awkward(spark):
    df = spark.createDataFrame([(*r, 9, "clash") for r in AWKWARD], "doc_id long, text string, node int, band string")
    assert Counter(map(tuple, odd_sketch.sketched_duplicates(df).collect())) == families(AWKWARD)
    assert odd_sketch.sketched_duplicates(df.limit(0)).collect() == []


def test_op13_estimates():
    """The estimate is close to the similarity, most where it is high; the exact bitmap rules out no linked pair."""
    rng = np.random.default_rng(1)
    for share, tolerance in ((0.95, 0.05), (0.85, 0.08), (0.7, 0.15)):
        errors = []
        for _ in range(40):
            base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            k = int(1000 * (1 - share) / (1 + share))
            a, b = np.unique(base[: 1000 - k]), np.unique(np.r_[base[: 1000 - 2 * k], base[1000 - k :]])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (np.frombuffer(odd_sketch.sketch_of(odd_sketch.samples_of(s), s), np.uint64) for s in (a, b))
            differ = int(np.bitwise_count(x[: odd_sketch.BITS // 64] ^ y[: odd_sketch.BITS // 64]).sum())
            errors.append(float(odd_sketch.estimate(differ)) - true)
            if odd_sketch.linked(a, b):
                assert odd_sketch.may_link(x, y, len(a), len(b))
        assert np.abs(errors).mean() < tolerance / 2 and np.abs(errors).max() < 2 * tolerance
    assert 0.6 < float(odd_sketch.estimate(odd_sketch.DIFFER_MOST)) < 0.85


def test_oracles_on_conversations(spark):
    """No node is lost at the sizes of the tables: members of the root are all conversations, leaves add up."""
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    root = prefix_trie(df).where("depth = 0").first()
    assert root.n_convs == df.agg(F.countDistinct("conv_id")).first()[0] and root.conv_id == df.agg(F.min("conv_id")).first()[0]
