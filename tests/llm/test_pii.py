import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import pii as P

from .frames import HARD, documents

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-0123456789 ()Zé", max_size=60))
def test_base_spans_follow_the_patterns(text):
    found = P.finder()(text)
    assert {k: found[k] for k in P.BASE} == brute(text)


def test_added_kinds():
    text = 'see HTTP://a.org/x?y=1). account: AB12-998877, iban GB82WEST12345698765432 iban GB83WEST12345698765432 token = "ab12cd34ef"'
    found = P.finder()(text)
    assert [text[a:b] for a, b in found["url"]] == ["HTTP://a.org/x?y=1"]
    assert [text[a:b] for a, b in found["account"]] == ["AB12-998877", "GB82WEST12345698765432", "ab12cd34ef"]


def test_hard_rows(spark):
    rows = HARD + [(50, "4111 1111 1111 1111 and 4111111111111112 a@b.c.d +1 (555) 123-4567 10.0.0.256 10.0.0.25", "en", "s")]
    got = sorted([tuple(r) for r in P.personal_data(documents(spark, rows, True)).collect()], key=repr)
    want = []
    for i, t, _, _ in rows:
        f = brute(t or "")
        base = ",".join(f"{k}:{a}:{b}" for k in P.BASE for a, b in f[k])
        want.append((i, *[len(f[k]) for k in P.BASE], hashlib.sha256(base.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    assert P.personal_data(documents(spark, [])).count() == 0


def test_whole_table(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in P.op8_personal_data(spark, sf_dir).collect():
        f = brute(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k in P.BASE for a, b in f[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
