"""Context-tree scores against a plain recursion over every context, and the base against plain counts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataline.llm import context_tree as T

from .frames import HARD, documents, prose


def decisions(text, depth):
    """(context, beginning of the byte's bits, bit) of every binary decision of a text."""
    whole = b"\xff" * depth + (text or "").encode().lower() + b"\xff"
    for k in range(depth, len(whole)):
        bits = format(whole[k], "08b")
        for j in range(8):
            yield whole[k - depth:k], bits[:j], int(bits[j])


class Tree:
    """The method by the book: block probabilities of whole subtrees, a decision's probability as their quotient is what ``path`` gives."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, beginning, bit in decisions(t, depth):
                for d in range(depth + 1):
                    c = context[depth - d:]
                    self.n[c, beginning][bit] += 1
                    if d < depth:
                        self.children[c, beginning].add(context[depth - d - 1:])
        self.weighted = {}

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def block(self, c, beginning, extra=None):
        """Log of the weighted probability of the subtree; with ``extra`` one more (context, bit)."""
        here = extra is not None and extra[0].endswith(c)
        if not here and (c, beginning) in self.weighted:
            return self.weighted[c, beginning]
        a, b = self.n.get((c, beginning), (0, 0))
        if here:
            a, b = a + (extra[1] == 0), b + (extra[1] == 1)
        out = self.kt(a, b)
        if len(c) < self.depth:
            below = set(self.children.get((c, beginning), ()))
            if here:
                below.add(extra[0][self.depth - len(c) - 1:])
            out = np.logaddexp(out, sum(self.block(x, beginning, extra) for x in below)) - math.log(2)
        if not here:
            self.weighted[c, beginning] = out
        return out

    def score(self, text):
        return sum(self.block(b"", beginning, (context, bit)) - self.block(b"", beginning) for context, beginning, bit in decisions(text, self.depth)) / math.log(10)


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def base(rows):
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)))
    return out


def same(got, rows, scores=None):
    want = base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2:5], round(r[5], 4))
    got, order = sorted(got, key=key), sorted(range(len(want)), key=lambda k: key(want[k]))
    assert [tuple(r)[:5] for r in got] == [want[k][:5] for k in order]
    assert np.allclose([r[5] for r in got], [want[k][5] for k in order], rtol=1e-9, atol=1e-9)
    if scores:
        assert np.allclose([r[6] for r in got], [scores[k] for k in order], rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_against_the_recursion(spark, most):
    rows = [(k, prose(k, 12)) for k in range(14)] + [(None, "Ünd é the END"), (20, None), (21, ""), (22, prose(1, 12)), (22, prose(1, 12)), (24, "a\n\tb  zzz"), *[(30 + k, "copy of one text") for k in range(8)]]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows], True)
    tree = Tree([t for i, t in rows if not held(i)], T.DEPTH)
    got = T.score(docs, most, most).collect()
    same(got, rows, [tree.score(t) for _, t in rows])


def test_probabilities_of_all_bytes_sum_to_one():
    tree = Tree([prose(k, 20) for k in range(5)], 2)
    for context in (b"he", b"zz", b"\xff\xff"):
        total = 0.0
        for byte in range(256):
            bits = format(byte, "08b")
            total += math.exp(sum(tree.block(b"", bits[:j], (context, int(bits[j]))) - tree.block(b"", bits[:j]) for j in range(8)))
        assert abs(total - 1) < 1e-9


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = T.op11_context_tree(spark, sf_dir).collect()
    same(got, rows)
    # the mixture beats eight fair decisions a byte by far on texts it has not seen
    bits = -sum(r["score"] for r in got if r["held_out"]) * math.log2(10) / sum(len((t or "").encode()) + 1 for i, t in rows if held(i))
    assert 1 < bits < 4


def test_hard_rows(spark):
    rows = [r[:2] for r in HARD]
    same(T.score(documents(spark, HARD, True)).collect(), rows)
    assert T.score(documents(spark, [])).count() == 0
    only = [(i, "text", None, None) for i in range(40) if held(i)]  # nothing to learn from
    got = T.score(documents(spark, only)).collect()
    assert only and all(r["base_score"] == 0 and r["train_tokens"] == 0 and abs(r["score"] + 5 * math.log10(256)) < 1e-9 for r in got)


def test_runs_cut_nothing(monkeypatch):
    text = prose(3, 300).encode()
    whole = T.grams(list(T.runs(text)))[0]
    monkeypatch.setattr(T, "RUN", 100)
    cut, size = T.grams(list(T.runs(text)))
    assert (cut == whole).all() and len(size) > 5 and size.sum() == len(text) + 1
    assert Counter(w for part in T.words(text) for w in part) == Counter(text.split())
