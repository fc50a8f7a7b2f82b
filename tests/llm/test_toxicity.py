import math

import numpy as np

from strataline.llm import toxicity as T

from .frames import HARD, documents, prose


def test_held_out(spark, sf_dir):
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    got = T.op5_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_nearest_examples_by_brute_force(spark):
    bad = ["idiot", "moronic", "trashy"]
    rows = [(k, prose(k, 40) + (f" {bad[k % 3]}{'s' * (k % 2)} " * (1 + k % 4) if k % 5 == 0 else ""), "en", "s") for k in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1 - k, int(k % 5 == 0)) for k in range(300)] + [(5, 0, 0), (None, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    model = T.learn(docs, labels)
    assert model is not None and {"idiot", "trash*"} <= set(model.vocabulary)
    known = T.Known(model.vocabulary)
    examples = []
    for k, i in enumerate(model.ids):
        t, w = model.vector(T.counted(known, rows[i][1]))
        examples.append(dict(zip(t.tolist(), w.tolist())))
    for i in range(300, 400):
        c = T.counted(known, rows[i][1])
        score, said = model.score(c)
        if not c:
            assert score == model.prior
            continue
        t, w = model.vector(c)
        cosine = [sum(x * e.get(k, 0) for k, x in zip(t.tolist(), w.tolist())) for e in examples]
        near = sorted(range(len(examples)), key=lambda k: (-cosine[k], k))[:T.NEIGHBOURS]
        near = [k for k in near if cosine[k] > 0]
        top = [cosine[k] for k in near]
        vote = [x * x * model.stands[k] for k, x in zip(near, top)]
        if len(set(np.round(sorted(cosine, reverse=True)[:T.NEIGHBOURS + 1], 9))) == len(top) + 1:
            want = (sum(v * model.label[k] for k, v in zip(near, vote)) + T.PRIOR_WEIGHT * model.prior) / (sum(vote) + T.PRIOR_WEIGHT)
            assert math.isclose(score, want, abs_tol=1e-9)
        assert math.isclose(float(said.split(",")[0].split(":")[2]), top[0], abs_tol=1e-3)
    held = T.scores(docs, model).filter("doc_id >= 300").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)


def test_hard_rows_and_nothing_labelled(spark):
    docs = documents(spark, HARD, True)
    for labels in ([], [(1, 0, None)], [(5, 0, 1), (5, 0, 0)], [(2, 0, 0)]):
        df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = T.scores(docs, T.learn(docs, df)).collect()
        assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    assert T.scores(documents(spark, []), None).count() == 0


def test_vocabulary_by_brute_force(spark):
    """Words in 0.3 % of the toxic texts are found, words spread evenly are not; the test is held against exact sums."""
    common = [f"evenly{k:02d}" for k in range(40)]
    rows = [(k, " ".join(common[(k // 2 * 7 + j * j) % 40] for j in range(5)) + f" t{k}" + (f" slur{k // 36}x" if k % 2 else ""), "en", "s") for k in range(12000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(12000)], "doc_id long, quality int, toxic int")
    sample, _ = T.labelled_sample(docs.select("doc_id", "text"), labels)
    texts = {(r["text"], r["toxic"]) for r in sample.collect()}
    n = [sum(y == v for _, y in texts) for v in (0, 1)]
    q, counts = n[1] / sum(n), {}
    for text, y in texts:
        for t in {t for w in set(T.words_of(text)) for t in T.terms_of(w)}:
            counts.setdefault(t, [0, 0])[y] += 1
    least = math.ceil(math.log(T.LEAST_P) / math.log(min(q, 1 - q)))

    def tail(k, size, p):
        return sum(math.comb(size, j) * p ** j * (1 - p) ** (size - j) for j in range(k, size + 1))
    tested = {t: tail(b, a + b, q) if b > (a + b) * q else tail(a, a + b, 1 - q) for t, (a, b) in counts.items() if least <= a + b <= 900}
    m = 2 * sum(a + b >= least for a, b in counts.values())
    ranked = sorted(tested.values())
    last = max((r for r, p in enumerate(ranked, 1) if p <= T.FALSE_SHARE * r / m), default=0)
    want = {t for t, p in tested.items() if last and p <= ranked[last - 1] * (1 + 1e-9)}
    got = {r["term"]: r for r in T.telling_terms(sample)}
    assert want == {t for t in got if sum(counts[t]) <= 900}
    rare = [t for t, (a, b) in counts.items() if t.startswith("slur") and t.endswith("x") and not a and b >= 14]
    assert rare and set(rare) <= set(got)
    assert len([t for t in got if t.startswith("evenly")]) <= 2 * T.FALSE_SHARE * len(got)  # the rate is an expectation
    assert len(T.telling_terms(sample, 5)) == 5


def test_bound_on_examples_where_ids_repeat(spark):
    rows = [(k % 3, prose(k, 12), "en", "s") for k in range(900)] + [(7, "the same text", "en", "s")] * 500
    docs = documents(spark, rows).select("doc_id", "text")
    labels = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 0), (7, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    whole, _ = T.labelled_sample(docs, labels)
    held = {i for i in (0, 1, 2, 7) if T.held_out_id(i)}
    assert whole.count() == 300 * len({0, 1, 2} - held) + (7 not in held)
    few, _ = T.labelled_sample(docs, labels, 20)
    assert all(n <= 20 for n in dict(few.groupBy("toxic").count().collect()).values()) and few.count() >= 20
