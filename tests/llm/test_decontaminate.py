import math
import random
from collections import Counter

import numpy as np
import pytest

from strataline.llm import blockmax as B
from strataline.llm import decontaminate as D

from .frames import HARD, documents, prose

ITEM = "item_id long, question string, answer string"


def test_threshold_and_best_equal_full_scoring():
    r = np.random.default_rng(3)
    for items, terms in ((1, 1), (40, 30), (100, 12)):
        dense = r.random((items, terms)) * (r.random((items, terms)) < 0.3) * r.choice([0.001, 1.0], terms)
        i, t = np.nonzero(dense)
        index = B.BlockMax(i, t, dense[i, t], items, terms)
        queries = r.random((25, terms)) * (r.random((25, terms)) < 0.5)
        q, qt = np.nonzero(queries)
        for least in (0.05, 0.4, 1.0):
            for light in (0.0, 0.01, 0.3):
                got = set(zip(*[x.tolist() for x in index.search(q, qt, queries[q, qt], least, light)[:2]]))
                full = queries @ dense.T
                assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(full >= least))}
        for k in range(25):
            used = np.flatnonzero(queries[k])
            got = index.best(used, queries[k][used], 7)
            full = dense @ queries[k]
            want = sorted(((-s, n) for n, s in enumerate(full) if s > 0))[:7]
            assert [n for n, _ in got] == [n for _, n in want] and np.allclose([s for _, s in got], [-s for s, _ in want])


def brute(rows, items):
    said = [(i, D.words_of(q), D.words_of(a)) for i, q, a in items]
    said = [x for x in said if x[1] or x[2]]
    n, df = len(said), Counter(t for _, q, a in said for t in set(q + a))
    avg = sum(len(q + a) for _, q, a in said) / max(1, n)
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    out = []
    for doc, text, *_ in rows:
        words = D.words_of(text)
        for i, q, a in said:
            both = q + a
            c = Counter(both)
            w = {t: idf[t] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(both) / avg)) for t, k in c.items()}
            size = 32
            while size < len(both):
                size *= 2
            best = None
            for v in range(max(1, -(-len(words) // size))):
                p = words[v * size:(v + 2) * size]
                s = sum(w[t] for t in set(p) if t in w) / sum(w.values())
                if s < D.THRESHOLD:
                    continue
                share = []
                for x in (q, a, both):
                    k = min(5, len(x))
                    g = {tuple(x[j:j + k]) for j in range(len(x) - k + 1)} if x else set()
                    h = {tuple(p[j:j + k]) for j in range(len(p) - k + 1)}
                    share.append(len(g & h) / len(g) if g else 1.0)
                if share[2] >= 0.8 or min(share[:2]) >= 0.8:
                    best = max(best or (0,), (round(s, 9), *share))
            if best:
                out.append((doc, i, *best))
    return sorted(out, key=repr)


ITEMS = [(1, "what is the color of the sky over the marsh at dawn", "a pale ember"), (2, prose(7, 90), "answer of the stone river"), (3, "", ""), (4, None, None),
         (5, "two words", None), (6, prose(9, 300), ""), (7, prose(9, 300), ""), (None, "an item without a number but with enough words to find", "yes")]


@pytest.mark.parametrize("shard", [D.SHARD_ITEMS, 3])
def test_matches_brute_force(spark, shard):
    r = random.Random(2)
    q = {i: f"{a or ''} {b or ''}" for i, a, b in ITEMS}
    rows = HARD + [(100 + k, prose(500 + k, r.randrange(400)) + "\n" + q[[1, 2, 5, 6, None][k % 5]].upper() + "! " + prose(700 + k, r.randrange(300)), "en", "s") for k in range(25)]
    rows += [(200, prose(9, 150), "en", "s"), (201, "what is the color of the sky over the marsh at dawn", "en", "s"), (202, "two words", "en", "s"), (203, prose(7, 80), "en", "s")]
    items = spark.createDataFrame(ITEMS, ITEM)
    got = sorted([(x[0], x[1], round(x[2], 9), *x[3:]) for x in map(tuple, D.contaminated_pairs(documents(spark, rows, True), items, shard).collect())], key=repr)
    want = brute(rows, ITEMS)
    assert len(want) > 20 and got == want
    kept = D.keep_clean(documents(spark, rows, True), items, shard_items=shard)
    bad = {w[0] for w in want}
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == sorted((x[0] for x in rows if x[0] not in bad), key=repr)


def test_empty_sides(spark):
    none = spark.createDataFrame([], ITEM)
    docs = documents(spark, HARD)
    assert D.contaminated_pairs(docs, none).count() == 0 and D.keep_clean(docs, none).count() == len(HARD)
    assert D.contaminated_pairs(documents(spark, []), spark.createDataFrame(ITEMS, ITEM)).count() == 0


def test_answer_is_the_last_sentence():
    assert D.split_answer("A b c. D e.") == ("A b c. ", "D e.") and D.split_answer("one") == ("one", "") and D.split_answer(None) == ("", "")


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(i, *D.split_answer(t)) for i, t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted([(x[0], x[1], round(x[2], 9), *x[3:]) for x in map(tuple, D.op1_decontamination(spark, sf_dir).collect())], key=repr)
    assert got == brute(rows, items)
