from collections import Counter

import duckdb
import pytest

from strataline.llm import site_lines as S

from .frames import HARD, documents


def brute(rows, ratio, least):
    total, seen = Counter(), Counter()
    for _, t, _, s in rows:
        total[s] += 1
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""} if t is not None else ():
            seen[s, line] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)) for i, t, _, s in rows), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_matches_brute_force(spark, clash):
    rows = HARD + [(100 + k, f"Menu \nown line {k}\n\nMenu\nshared {k % 3}\nFooter", "en", "hot" if k % 3 else None) for k in range(40)]
    for ratio, least in ((0.02, 5), (0.5, 2), (0.0, 1)):
        df = documents(spark, rows, clash)
        out = S.drop_boilerplate(df, "source", ratio=ratio, min_pages=least)
        assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
        assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == brute(rows, ratio, least)


def test_empty_table(spark):
    assert S.drop_boilerplate(documents(spark, []), "source").count() == 0


def test_host(spark):
    df = spark.createDataFrame([("http://WWW.a.example.com:80/x",), ("https://u:p@b.org?q",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in df.select(S.host(df.url)).collect()] == ["a.example.com", "b.org", None, None]


def test_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = [tuple(r) for r in S.op7_site_line_frequency(spark, sf_dir).select("doc_id", "n_dropped", "n_lines", "text").collect()]
    want = db.execute(f"SELECT doc_id, n_dropped, n_lines, text FROM ({S.OP7_SQL})").fetchall()
    assert sorted(got) == sorted(want)


def test_no_python_in_plan(spark, sf_dir):
    plan = S.op7_site_line_frequency(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_clashing_columns_come_back(spark):
    rows = [(k, f"menu\nown {k}", "x", "mine", "theirs", 7) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __site string, `__drop` string, __row int")
    for distinct in (False, True):
        got = S.drop_boilerplate(df, "source", distinct_texts=distinct)
        assert got.columns == [*df.columns, "__n_lines", "__n_dropped"]
        assert sorted(map(tuple, got.collect())) == [(k, f"own {k}", "x", "mine", "theirs", 7, 2, 1) for k in range(10)]
