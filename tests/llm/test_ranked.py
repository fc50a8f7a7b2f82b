"""Ranked search against scoring every document, and the bounds of its blocks."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataline.llm import ranked as R

from .frames import HARD, documents, prose

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=R.TOP):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    total, words, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    for t in ["Ab,c É1é漢\xa0x\x7f_y", "", None, " ²½ İ K", "a\x80b"]:
        assert [x.decode() for x in R.terms_of(t)] == terms(t)


def test_query_and_sql(spark, sf_dir):
    got = sorted(map(tuple, R.op12_ranked_search(spark, sf_dir).collect()), key=repr)
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(db.execute(R.OP12_SQL).fetchall(), key=repr) == got


def test_hard_rows_and_groups_of_items(spark, monkeypatch):
    rows = [*HARD, *[(100 + k, prose(k, 30), "en", "c") for k in range(40)], *[(200 + k, "river stone cloud", "en", "c") for k in range(15)]]
    items = [(k, prose(k, 6)) for k in range(9)] + [(9, None), (10, ""), (11, "river STONE river"), (11, "ember"), (11, "ember"), (None, "grain marsh"), (12, "unheard")]
    docs = documents(spark, rows, True)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute([r[:2] for r in rows], list(dict.fromkeys(items)))
    for most in (R.MOST_ITEMS, 4):
        assert sorted(map(tuple, R.best_documents(docs, benchmark, most_items=most).collect()), key=repr) == want
    assert R.best_documents(documents(spark, []), benchmark).count() == 0
    assert R.best_documents(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_skipped_blocks_hold_no_result(seed):
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 12, 1500)
    impact = np.zeros((1500, 60), np.float32)
    for d in range(1500):
        own = np.unique(np.concatenate([topic[d] * 5 + rng.integers(0, 5, 4), rng.integers(0, 60, 2)]))
        impact[d, own] = rng.integers(1, 1_000_000, len(own))
    lists = [np.unique(np.concatenate([t * 5 + rng.integers(0, 5, 4), rng.integers(0, 60, 1)])).tolist() for t in rng.integers(0, 12, 30)]
    weights = rng.integers(0, 9000, 60).astype(np.float64)
    group, best, opened = R.Group(lists, weights), R.Best(30, 10), Counter()
    keys = [(False, d, 0) for d in range(1500)]
    for a in range(0, 1500, 400):
        R.search(group, impact[a:a + 400][:, group.terms], keys[a:a + 400], best, 0, opened, block=8)
    for k, own in enumerate(lists):
        score = impact[:, own].astype(np.float64) @ weights[own]
        order = sorted((-s, False, d, 0) for d, s in enumerate(score.tolist()) if s > 0)[:10]
        assert best.held[k] == order
    assert 0 < opened["opened"] < 0.7 * opened["blocks"]
