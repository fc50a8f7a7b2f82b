import numpy as np

from strataline.llm import language as L

from .frames import HARD, documents, prose


def model(spark, sf_dir):
    return L.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def test_held_out_accuracy(spark, sf_dir):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.op10_language_mixture(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_em_against_the_definition():
    r = np.random.default_rng(1)
    like = r.random((200, 3)) + 0.01
    share, fit = L.em(like, np.ones(200), 500)
    assert abs(share.sum() - 1) < 1e-9
    for _ in range(200):  # no other mixture fits better
        other = r.dirichlet(np.ones(3))
        assert np.log(like @ other).sum() <= fit + 1e-2


def test_mixed_text_has_both_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang in ('fr', 'en') and length(text) > 400").orderBy("doc_id").collect()
    one = {k: next(r["text"] for r in docs if r["lang"] == k)[:400] for k in ("fr", "en")}
    langs, logp = model(spark, sf_dir)
    both = {langs[i]: x for i, x in L.mixture(logp, one["fr"] + " " + one["en"])}
    assert {"fr", "en"} <= set(both) and min(both["fr"], both["en"]) > 0.3
    assert [langs[i] for i, _ in L.mixture(logp, one["fr"])] == ["fr"]


def test_hard_rows(spark):
    rows = HARD + [(100 + k, prose(k, 60), "en", "s") for k in range(20)] + [(200 + k, "ça été où ñandú " * 20, "fr", "s") for k in range(20)]
    docs = documents(spark, rows, True)
    langs, logp = L.learn(docs.select("doc_id", "text", "lang"))
    got = L.predict(docs, langs, logp).collect()
    assert len(got) == len(rows)
    und = sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"))
    assert und == [1, 2, 3, 4]
    kept = L.keep_known(docs, langs, logp)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


def test_nothing_learned(spark):
    docs = documents(spark, [(1, "words here", None, "s")])
    langs, logp = L.learn(docs.select("doc_id", "text", "lang"))
    assert langs == [] and [r["lang_pred"] for r in L.predict(docs, langs, logp).collect()] == ["und"]
    assert L.predict(documents(spark, []), langs, logp).count() == 0


def test_numbers_are_no_letters_and_all_labels_are_learned(spark):
    from strataline.llm import language
    docs = spark.createDataFrame([(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x words", f"l{k:03d}") for k in range(260)] + [(1000, "²½ Ⅷ", None), (1001, "é½", None)], "doc_id long, text string, lang string")
    langs, logp = language.learn(docs)
    assert len(langs) == sum(not language.held_out_id(k) for k in range(260))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.filter("doc_id >= 1000"), langs, logp).collect()}
    assert got[1000] == language.UNKNOWN and got[1001] in langs
