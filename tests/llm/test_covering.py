import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import components as G
from strataline.llm import covering as C

from .frames import HARD, documents, exchanges, prose


def brute_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_roots(fps, bits=3):
    top = list(range(len(fps)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return [root(k) for k in range(len(fps))]


def brute_components(ids, fps, bits=3):
    least, own = {}, brute_roots(fps, bits)
    for k, i in enumerate(ids):
        if i is not None:
            least[own[k]] = min(least.get(own[k], i), i)
    return [least.get(r) for r in own]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1c éÀ", max_size=40))
def test_fingerprint(text):
    assert C.fingerprint(text) == brute_fp(text)


def test_spark_hash_agrees(spark):
    for w in ("one two three", "é à"):
        got = spark.sql(f"SELECT xxhash64('{w}')").head()[0]
        assert got == C.signed(C.fingerprint(w))


def test_anchors_cover_every_link():
    r = random.Random(5)
    x = np.array([r.getrandbits(64) for _ in range(300)] + [0, 1, (1 << 64) - 1], np.uint64)
    at, an = C.anchors([x])
    sets = [set(an[at == k].tolist()) for k in range(len(x))]
    for k, v in enumerate(x.tolist()):
        assert {len([a for a in sets[k] if a >> 31 == h]) for h in (0, 1)} <= {1, 16}
        for a in sets[k]:
            half = v >> (32 * (a >> 31)) & 0x7FFFFFFF
            assert (half ^ a & 0x7FFFFFFF).bit_count() <= 2
        flips = r.sample(range(64), 3)
        y = v
        for b in flips:
            y ^= 1 << b
            _, other = C.anchors([np.array([y], np.uint64)])
            assert sets[k] & set(other.tolist())


def test_anchors_cover_links_of_two_numbers():
    r = random.Random(6)
    for _ in range(100):
        v = r.getrandbits(128)
        w = v
        for b in r.sample(range(128), 7):
            w ^= 1 << b
        a, b = ({*C.anchors([np.array([x >> 64], np.uint64), np.array([x & (1 << 64) - 1], np.uint64)])[1].tolist()} for x in (v, w))
        assert a & b and len({x >> 31 for x in a}) == 4


def near_fps(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 10)]
    out = []
    for _ in range(n):
        v = r.choice(base)
        for _ in range(r.randrange(7)):
            v ^= 1 << r.randrange(64)
        out.append(v)
    return out


def test_components_of_random_fingerprints(spark):
    fps = near_fps(700, 1) + [0b111, 0, 0b111000]
    ids = list(range(len(fps)))
    for largest in (C.LARGEST, 20):
        df = spark.createDataFrame([(C.signed(f),) for f in sorted(set(fps))], "fp long")
        edges = C.link_edges(df, largest)
        assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1) >= 0 for r in edges.collect())
        rounds = G.components(edges)
        root = {r["fp"]: r["root"] for r in G.follow(df, "fp", rounds, "root").collect()}
        want = brute_components(ids, fps)
        seen = {}
        for f, w in zip(fps, want):
            assert seen.setdefault(root[C.signed(f)], w) == w
        assert len(set(root.values())) == len(set(want))


def test_dense_anchor_keeps_components():
    fps = np.unique(np.array(near_fps(400, 3), np.uint64))
    u, v = C._dense([fps])
    for a, b in ((u, v), C.links(np.zeros(len(fps), np.int64), [fps])):
        parent = {x: x for x in fps.tolist()}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for x, y in zip(a.tolist(), b.tolist()):
            parent[root(x)] = root(y)
        want = brute_components(range(len(fps)), fps.tolist())
        groups = {}
        for x, w in zip(fps.tolist(), want):
            assert groups.setdefault(root(x), w) == w
        assert len(groups) == len(set(want))


def test_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5)]
    rounds = G.components(spark.createDataFrame(edges, "u long, v long"))
    nodes = spark.createDataFrame([(k,) for e in edges for k in e], "n long")
    got = {(r["n"], r["root"]) for r in G.follow(nodes, "n", rounds, "root").collect()}
    assert got == {(k, 0) for k in range(61)} | {(1000 + k, 1000) for k in range(40)}


def brute_kept(rows):
    """doc_ids that stay, one for each component: its smallest, or null. ``rows``: doc_id, text."""
    kept = {}
    for (i, _), r in zip(rows, brute_roots([brute_fp(t) for _, t in rows])):
        kept[r] = min(kept.get(r, (True, 0)), (i is None, i or 0))
    return [None if none else i for none, i in kept.values()]


ROWS = HARD + [(100 + k, prose(k // 4, 200) + (" extra" if k % 4 == 3 else ""), "en", "s") for k in range(40)] + [(None, None, None, None)]


def test_hard_rows(spark):
    got = C.near_classes(documents(spark, ROWS, True)).collect()
    want = brute_components([r[0] for r in ROWS], [brute_fp(r[1]) for r in ROWS])
    rows = sorted(((r[0], C.signed(brute_fp(r[1])), w) for r, w in zip(ROWS, want)), key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == rows
    kept = C.keep_one(documents(spark, ROWS, True))
    assert kept.columns == documents(spark, ROWS, True).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(brute_kept([r[:2] for r in ROWS]), key=repr)
    assert C.near_classes(documents(spark, [])).count() == 0 and C.keep_one(documents(spark, [])).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [brute_fp(t) for _, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps)))
    assert sorted(tuple(r) for r in C.op9_simhash_covering(spark, sf_dir).collect()) == want


def test_no_other_text_goes_with_a_doc_id(spark):
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [(1, a), (5, a), (5, b), (5, c), (None, prose(4, 60)), (None, prose(5, 60)), (7, c), (9, prose(6, 60)), (9, prose(6, 60)), (None, a)]
    for clash in (False, True):
        got = C.keep_one(documents(spark, [(i, t, "en", "s") for i, t in rows], clash)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, a), (5, b), (5, c), (None, rows[4][1]), (None, rows[5][1]), (9, rows[7][1])], key=repr)


def test_texts_that_stay_are_not_shuffled(spark):
    rows = [(k, prose(k, 60), "en", "s") for k in range(300)] + [(300 + k, prose(k, 60), "en", "s") for k in range(20)]
    rows += [rows[50], rows[60]]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = C.keep_one(documents(spark, rows))
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    moved = [n for columns, n in exchanges(kept._jdf.queryExecution().executedPlan()) if "text" in columns]
    assert moved and sum(moved) < 60  # 24 rows go or are repeated, each in one or two exchanges
