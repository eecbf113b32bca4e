import random

import xxhash
from pyspark.sql import functions as F

from copair.llm import simhash_ring
from copair.llm.components import components
from tests.llm.helpers import no_docs, odd_docs, rows_of


def brute_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for text in (None, "", "  ", "One", "a B", "a b C", "AÉ b c d e f", "x y z " * 50, "t\x0bu\x1cv w x"):
        assert simhash_ring.fingerprint(text) == brute_fingerprint(text)
    same = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash_ring.fingerprint("a b c") == same % 2**64


def brute_components(fps, ids, most=3):
    up = list(range(len(fps)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(fps))]


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    want = brute_components([brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    got = rows_of(simhash_ring.near_duplicates(docs), "id", "component_id")
    assert got == sorted(zip([r["doc_id"] for r in rows], want), key=repr)
    kept = simhash_ring.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(w for w in want if w is not None))


def near_prints(n_groups=40):
    rng = random.Random(5)
    out = set()
    for _ in range(n_groups):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(1, 12)):
            near = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                near ^= 1 << b
            out.add(near)
    return sorted(out)


def test_links_lose_nothing_with_and_without_split_keys(spark):
    fps = near_prints()
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = {(max(signed[i], signed[j]), min(signed[i], signed[j])) for i in range(len(fps)) for j in range(i)
            if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert want
    for hot in (2000, 2):
        got = [(r["u"], r["v"]) for r in simhash_ring.links(nodes, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (50, 50), (7, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert simhash_ring.near_duplicates(no_docs(spark)).count() == 0
    assert simhash_ring.keep_one(no_docs(spark)).count() == 0


def test_repeated_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "one two three four five"), (1, "one two three four five"),
                                  (2, "one two three four five")], "doc_id long, text string")
    assert rows_of(simhash_ring.keep_one(docs), "doc_id", "text") == [(1, "alpha beta gamma delta"), (1, "one two three four five")]


def plain_keep_one(rows, max_bits=3):
    """Ids and texts kept, by brute force over rows ``(id, text)``."""
    prints = [simhash_ring.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    groups = {g: [r for r, h in zip(rows, group) if h == g] for g in set(group)}
    low = {g: min((i for i, _ in rs if i is not None), default=None) for g, rs in groups.items()}
    return [(low[g], {t for i, t in rs if i == low[g]}) for g, rs in groups.items()]


def near_copy(text):
    words = text.split()
    for k in range(len(words)):
        other = " ".join(words[:k] + ["changed"] + words[k + 1:])
        bits = (simhash_ring.fingerprint(text) ^ simhash_ring.fingerprint(other)).bit_count()
        if 1 <= bits <= 3:
            return other
    raise AssertionError("no near copy")


def test_keep_one_decides_per_row(spark):
    rng = random.Random(8)
    long_text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    a, c, e = long_text(), long_text(), long_text()
    rows = [(3, c), (5, a), (5, near_copy(c)), (7, e), (None, near_copy(e)), (None, long_text()), (None, long_text()), (None, a),
            (8, None), (None, None), (None, "")] + [(None, long_text()) for _ in range(20)]
    rows += [rows[-1]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, got = plain_keep_one(rows), rows_of(simhash_ring.keep_one(docs), "doc_id", "text")
    assert len(got) == len(want)
    for i, texts in want:
        assert sum(g[0] == i and g[1] in texts for g in got) == 1


def test_one_null_group_does_not_keep_other_null_rows(spark):
    docs = spark.createDataFrame([(None, "one two three four five"), (None, "alpha beta gamma"), (2, "alpha beta gamma")],
                                 "doc_id long, text string")
    assert rows_of(simhash_ring.keep_one(docs), "doc_id", "text") == [(2, "alpha beta gamma"), (None, "one two three four five")]


def test_keep_one_collects_no_arrays(spark):
    docs = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    plan = simhash_ring.keep_one(docs)._jdf.queryExecution().toString()
    assert "collect_" not in plan
