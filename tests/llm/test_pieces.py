import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import pieces as P

from .frames import HARD, documents


@pytest.fixture(scope="module")
def both():
    return P.Transducer(P.Model(P.model_bytes())), sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


text = st.one_of(st.text(max_size=30), st.text(alphabet="the ir▁ \n.,'²éa0", max_size=40), st.lists(st.sampled_from(["the", " ", "  ", "in", "ing", "---", "\U0001f600", "汉", "<s>", "\t", "(", "²."]), max_size=12).map("".join))


@settings(max_examples=500, deadline=None)
@given(text)
def test_equals_the_library(both, t):
    if any("\ud800" <= c <= "\udfff" for c in t):
        return
    fst, lib = both
    ids = np.frombuffer(fst.encode(t), np.int32)
    assert ids.tolist() == lib.encode(t)
    assert fst.decode(ids) == lib.decode(lib.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_decodes_any_ids(both, ids):
    fst, lib = both
    said = lib.decode(ids)
    if "�" not in said and "⁇" not in said and not set(ids) & {0, 1, 2}:
        assert fst.decode(np.array(ids, np.int32)) == said


def test_whole_table(spark, sf_dir, both):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = P.op4_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["ids"] == both[1].encode(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_hard_rows(spark, both):
    got = P.encode(documents(spark, HARD, True)).collect()
    want = [(i, None if t is None else both[1].encode(t), t) for i, t, _, _ in HARD]
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    assert P.encode(documents(spark, [])).count() == 0
