import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import fingerprints as P

from .frames import HARD, documents

texts = st.text(alphabet="ab\x00é\U0001f600", max_size=40)


@settings(max_examples=150, deadline=None)
@given(texts, texts, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = P.Prefixes.of(a), P.Prefixes.of(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert P.common_prefix(x, i, y, j) == k
    k = 0
    while k < min(i, j) and a[i - k - 1] == b[j - k - 1]:
        k += 1
    assert P.common_suffix(x, i, y, j) == k
    assert (x.fingerprint() == y.fingerprint()) == (a == b)
    s = x.spliced(i, y, j)
    t = P.Prefixes.of(a[:i] + b[:j])
    assert s.fingerprint() == t.fingerprint() and all((u == v).all() for u, v in zip(s.sums, t.sums))


def brute(rows):
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 2
        e = t[:len(t) - n] + nxt[:n]
        p = [P.Prefixes.of(v) for v in (t, e, nxt)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p[0].fingerprint(), p[1].fingerprint(), P.likeness(p[0], p[1]), P.likeness(p[0], p[2])))
    return sorted(out, key=repr)


def test_next_document_over_pieces(spark):
    rows = HARD + [(k * 7 % 101 + 20, f"document number {k} " * (k % 5), "en", "s") for k in range(60)]
    for pieces in (1, 2, 7, 40):
        got = P.fingerprints(documents(spark, rows, True), pieces).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_one_row_none_and_null_ids(spark):
    for rows in ([], [(3, "only", "en", "s")], [(None, "a", "en", "s"), (None, "b", "en", "s")], [(1, "q", "en", "s")] * 3):
        assert sorted([tuple(r) for r in P.fingerprints(documents(spark, rows), 4).collect()], key=repr) == brute(rows)


def test_likeness_of_an_edit():
    a, b = P.Prefixes.of("a" * 100), P.Prefixes.of("a" * 50 + "b" * 50)
    assert P.likeness(a, b) == 0.5 and P.likeness(a, a) == 1 and P.likeness(P.Prefixes.of(""), P.Prefixes.of("")) == 1
    assert P.likeness(P.Prefixes.of("abcd"), P.Prefixes.of("")) == 0
