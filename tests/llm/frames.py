"""Small frames with the hard cases: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["line", "site", "row", "word", "piece", "item_id", "score", "fp", "__row"]


def documents(spark, rows, clash=False):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, l, s, len(t or "")) for i, t, l, s in rows]
    if not clash:
        return spark.createDataFrame(full, DOC)
    return spark.createDataFrame([r + tuple("x" for _ in CLASH) for r in full], DOC + "".join(f", `{c}` string" for c in CLASH))


def prose(seed, n, words=("the", "of", "and", "tion", "whale", "river", "stone", "cloud", "ember", "grain", "lantern", "marsh")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (r.choice(words) if r.random() < 0.5 else "") for _ in range(n))


def exchanges(plan):
    """Columns and rows written of every shuffle of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchanges(plan.executedPlan())
    if name.endswith("QueryStage"):
        return exchanges(plan.plan())
    own = []
    if name == "Exchange":
        out = plan.output()
        own = [([out.apply(k).name() for k in range(out.size())], plan.metrics().apply("shuffleRecordsWritten").value())]
    below = plan.children()
    return [x for k in range(below.size()) for x in exchanges(below.apply(k))] + own


HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\n ", "en", "a"), (4, "12345 !!", None, "a"),
    (5, "same text here\nsecond line", "en", "b"), (5, "same text here\nsecond line", "en", "b"), (6, "same text here\nsecond line", "en", None),
    (None, "no id at all \U0001f600 é", "fr", "b"), (7, "x" * 50_000, "en", "c"), (8, "\n".join(prose(8, 20) for _ in range(300)), "en", "c"),
]
