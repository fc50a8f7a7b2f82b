"""Alignment of two tokenizers against whole-text tokenization and plain set intersection."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataline.llm import alignment as A
from strataline.llm.lookup import Numbers, frequent

from .frames import HARD, documents, prose

FILES = f"{A.TOKENIZERS}/{A.BYTE_LEVEL}", f"{A.TOKENIZERS}/{A.PIECES}"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(*(open(f, "rb").read() for f in FILES))


def whole(libraries, text):
    """(a ids, b ids, groups) of a text tokenized whole, or None."""
    if not text:
        return None
    a, b = libraries
    known = A.byte_level_alphabet()
    x = a.encode(" " + text, add_special_tokens=False)
    said = [bytes(known[c] for c in a.id_to_token(i)) for i in x.ids]
    y = b.encode(text)
    pieces = [bytes([i - 3]) if 3 <= i < 259 else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    want = (" " + text).encode()
    if b"".join(said) != want or b"".join(pieces) != want:
        return None
    ends = [set(np.cumsum([len(s) for s in p]).tolist()) for p in (said, pieces)]
    both, groups, i, j, at_a, at_b = sorted(ends[0] & ends[1]), [], 0, 0, 0, 0
    for end in both:
        ga, gb = [], []
        while at_a < end:
            at_a += len(said[i])
            ga.append(x.ids[i])
            i += 1
        while at_b < end:
            at_b += len(pieces[j])
            gb.append(y[j])
            j += 1
        groups.append((ga, gb))
    return x.ids, y, groups


def brute(libraries, rows):
    done = [(i, whole(libraries, t)) for i, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, w in done if w for g in w[2])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, w in done:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in w[2])
        links = [(a[-1], b[-1]) for a, b in w[2]]
        out.append((i, len(w[0]), len(w[1]), len(w[2]), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


numbers = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), max_size=5))
def test_common_ends(texts):
    base, a, b, want = 0, [], [], []
    for x, y in texts:
        want += [(len(a) + x.index(e), len(b) + y.index(e)) for e in sorted({*x} & {*y})]
        a += [base + e for e in x]
        b += [base + e for e in y]
        base += 100
    sizes = [np.array([len(t[k]) for t in texts], np.int64) for k in (0, 1)]
    got = A.common_ends(np.array(a, np.int64), np.array(b, np.int64), *sizes)
    assert list(zip(*map(np.ndarray.tolist, got))) == want


parts = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the", " ", "  ", "in", "ing", "'s", "12", "\n", "\t ", " ", "\x1c", "é", "汉字", "<s>", "<|endoftext|>", "▁", "\U0001f600", "don't", "...", " "]), max_size=14).map("".join))


@settings(max_examples=500, deadline=None)
@given(parts)
def test_parts_equal_whole_texts(libraries, aligner, text):
    if not text or any("\ud800" <= c <= "\udfff" for c in text):
        return
    want = whole(libraries, text)
    at = aligner.places([text])[0]
    assert bool(aligner.bad[at].any()) == (want is None)
    if want:
        assert aligner.n[:, at].sum(axis=1).tolist() == [len(want[0]), len(want[1]), len(want[2])]
        assert ";".join(aligner.text[k] for k in at) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[2])


def test_slices_join_to_the_text():
    text = prose(3, 500) + "  two \n blanks"
    assert " ".join(A.slices(text, 100)) == text and len(list(A.slices(text, 100))) > 5


@pytest.mark.parametrize("most", [A.MOST_PAIRS, 40])
def test_query(spark, sf_dir, libraries, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute(libraries, [tuple(r) for r in docs.collect()])
    got = A.op13_tokenizer_alignment(spark, sf_dir) if most == A.MOST_PAIRS else A.align(docs, most_pairs=most)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_hard_rows(spark, libraries, monkeypatch):
    rows = [*HARD, (9, "a ▁ mark", "en", "c"), (10, "<|endoftext|> <s> </s>", "en", "c"), *[(20 + k, "a copy of one text " * 3, "en", "c") for k in range(9)]]
    want = brute(libraries, [(i, t) for i, t, _, _ in rows])
    for most, remembered in ((A.MOST_PAIRS, A.REMEMBERED), (3, 50)):
        got = A.align(documents(spark, rows, True), most_pairs=most, remembered=remembered)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert A.align(documents(spark, [])).count() == 0


def test_a_long_text_goes_in_slices(libraries, aligner, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 2000)
    import pyarrow as pa
    text = prose(5, 4000)
    batch = pa.RecordBatch.from_arrays([pa.array(["short", text, text + "▁"])], names=["text"])
    got = [(good, sum(len(p) for p in parts)) for _, good, parts in A.aligned(aligner, [batch], "text")]
    assert got == [(True, 1), (True, 4000), (False, 0)]


def test_numbers_and_cut(spark):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    index = Numbers(keys[::2].copy())
    found = index.find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()
    assert (Numbers(np.zeros(0, np.int64)).find(keys) == -1).all()
    counts = spark.createDataFrame([(k, int(n)) for k, n in enumerate(rng.zipf(1.3, 3000))], "k long, n long")
    for most in (0, 5, 100, 10_000):
        top, left = frequent(counts, "n", most), counts.join(frequent(counts, "n", most), "k", "left_anti")
        assert top.count() <= most and (most < 10_000 or left.count() == 0)
