import hashlib

import sentencepiece

import corpus_pipeline as C
from strataline.llm import pieces
from strataline.session import materialise

from .frames import HARD, documents
from .test_covering import brute_kept
from .test_decontaminate import brute as leaks
from .test_decontaminate import D
from .test_site_lines import brute as lines
from .test_site_lines import S


def steps(spark, docs, folder):
    out = [docs]
    for _, f in C.STAGES:
        out.append(materialise(f(spark, out[-1], folder)))
    return out


def check(spark, docs, folder):
    got = steps(spark, docs, folder)
    for d in got[1:-1]:
        assert d.columns == C.COLUMNS
    rows = [[tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()] for d in got[:-1]]
    has_letter = [r for r in rows[0] if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(rows[1], key=repr) == sorted(has_letter, key=repr)
    assert sorted([(r[0], r[1]) for r in rows[2]], key=repr) == lines(rows[1], S.RATIO, S.MIN_PAGES)
    assert all(r["n_chars"] == len(r["text"]) for r in got[2].collect())
    assert sorted([r[0] for r in rows[3]], key=repr) == sorted(brute_kept([r[:2] for r in rows[2]]), key=repr)
    items = [(i, *D.split_answer(t)) for i, t in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in leaks(rows[3], items)}
    assert sorted(rows[4], key=repr) == sorted([r for r in rows[3] if r[0] not in bad], key=repr)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r[0]: r[1] for r in rows[4]}
    last = got[5].collect()
    assert len(last) == len(rows[4])
    for r in last:
        assert r["ids"] == lib.encode(text[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_stages_over_the_table(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_stages_over_hard_rows(spark, sf_dir):
    check(spark, documents(spark, [*HARD, *[(300 + k, "the menu line\nown text number " + str(k) * 3, "en", "a") for k in range(20)]], True), sf_dir)


def test_run_and_empty(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0 and C.ORACLE_SQL is None
    docs = documents(spark, [])
    for _, f in C.STAGES:
        docs = f(spark, docs, sf_dir)
    assert docs.count() == 0


def test_language_without_labels(spark, sf_dir):
    docs = documents(spark, [(i, t, None, s) for i, t, _, s in HARD])
    got = sorted((r["doc_id"] or 0 for r in C.known_language(spark, docs, sf_dir).collect()))
    assert got == [0, 5, 5, 6, 7, 8]


def test_copies_do_not_make_boilerplate(spark, sf_dir):
    copied = "\n".join(f"line {k} of the copied text" for k in range(6))
    rows = [(k, copied if k % 3 == 0 else f"footer\nown text {k}\nand its second line {k}", "en", "s") for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in C.site_boilerplate(spark, documents(spark, rows), sf_dir).collect()}
    assert got == {k: copied if k % 3 == 0 else f"own text {k}\nand its second line {k}" for k in range(60)}
    one = C.near_duplicates(spark, documents(spark, [(k, t, "en", "s") for k, t in got.items() if t == copied]), sf_dir).collect()
    assert [(r["doc_id"], r["text"]) for r in one] == [(0, copied)]
