"""Line dedup by site-relative frequency (DataFrame functions only).

For every site (host), the share of its pages that contain a line is measured; lines above the boilerplate ratio are dropped from
the pages of that site. Lines travel as 128-bit hashes, never as text.

Defined results
* A line counts once per page. Lines are compared without leading and trailing spaces; blank lines are never dropped.
* A row is a page: repeated rows count as several pages and get the same result. With ``distinct_texts`` equal texts of a site count as
  one page, so that copies of a text do not make its lines boilerplate. A null site is a site of its own.
* Null text stays null and has no lines; empty text has one blank line. A page may end up empty; it is kept.
* Extra columns pass through unchanged.
* An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import prepare, row_key, table

#: A line on more than this share of a site's pages is boilerplate.
RATIO = 0.02
#: ... if it is on this many pages at least, so that a small site does not lose its own text.
MIN_PAGES = 5


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a leading "www."; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def _line_hash(line: Column) -> Column:
    return row_key(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Hashes of the different lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _line_hash))


def site_totals(pages: DataFrame, site: str = "site") -> DataFrame:
    return pages.groupBy(F.col(site).alias("site")).agg(F.count(F.lit(1)).alias("site_pages"))


def distinct_totals(keyed: DataFrame) -> DataFrame:
    """Site and its number of different texts. ``keyed``: site, text."""
    once = keyed.select("site", row_key(F.col("site"), F.col("text")).alias("row")).groupBy("site", "row").agg(F.lit(1).alias("one"))
    return once.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))


def boilerplate(keyed: DataFrame, ratio: float, min_pages: int, distinct_texts: bool = False) -> DataFrame:
    """Site, line hash, pages with it and pages of the site, for the lines to drop. ``keyed``: site, text. With
    ``distinct_texts`` the pages of the site are its different texts, but those with the line all its rows: lines that may be dropped."""
    seen = keyed.select("site", F.explode(_hashes(F.col("text"))).alias("line"))
    counts = seen.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    totals = (distinct_totals if distinct_texts else site_totals)(keyed).withColumnRenamed("site", "total_site")
    # frequent lines are few per site (lines of a page / ratio at most), so both sides of this join are small
    return counts.join(totals, F.col("site").eqNullSafe(F.col("total_site"))).filter(
        F.col("pages") > ratio * F.col("site_pages")).select("site", "line", "pages", "site_pages")


def drop_boilerplate(pages: DataFrame, site: str = "site", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     distinct_texts: bool = False) -> DataFrame:
    """All columns and rows of ``pages`` with the boilerplate lines taken out of ``text``, and ``__n_lines``, ``__n_dropped``."""
    keyed = pages.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text"))
    drop = boilerplate(keyed, ratio, min_pages, distinct_texts)
    if distinct_texts:
        # the few lines that may be dropped are counted again, once for each different text
        may = drop.select(F.xxhash64("site", "line.a", "line.b").alias("drop_key"), F.col("site").alias("drop_site"), F.col("line").alias("drop_line"), "site_pages")
        lines = keyed.select(row_key(F.col("site"), F.col("text")).alias("row"), "site", F.explode(_hashes(F.col("text"))).alias("line"))
        lines = lines.withColumn("line_key", F.xxhash64("site", "line.a", "line.b"))
        # both sides are dealt by a computed key, so that a line on a third of all pages can be split over tasks
        same = (F.col("line_key") == F.col("drop_key")) & F.col("site").eqNullSafe(F.col("drop_site")) & (F.col("line") == F.col("drop_line"))
        once = lines.join(may, same).groupBy("row", "site", "line").agg(F.max("site_pages").alias("site_pages"))
        drop = once.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"), F.max("site_pages").alias("site_pages")).filter(
            (F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("site_pages")))
    # a page has lines / ratio boilerplate lines at most, so one row holds those of a site; written, so that the join below is dealt anew
    # and a site with a third of all pages can be split
    taken = set(pages.columns)
    own, dropped, suspects, left = (next(n for n in (f"{c}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for c in ("__site", "__drop", "__suspects", "__left"))
    by_site = materialise(drop.groupBy("site").agg(F.collect_set("line").alias(dropped)).withColumnRenamed("site", own))
    out = pages.join(by_site, F.col(f"`{site}`").eqNullSafe(F.col(own)), "left")
    # hashes of the page that the site drops by their first half, a set operation on numbers; the lines that are left are compared whole
    lines, first = _lines(F.col(f"`{text}`")), F.transform(F.col(dropped), lambda d: d["a"])
    out = out.withColumn(suspects, F.array_intersect(F.transform(lines, lambda x: _line_hash(x)["a"]), first))
    gone = lambda x: (F.trim(x) != "") & F.array_contains(F.col(suspects), _line_hash(x)["a"]) & F.array_contains(F.col(dropped), _line_hash(x))
    touched = F.col(dropped).isNotNull() & F.col(f"`{text}`").isNotNull() & (F.size(F.col(suspects)) > 0)
    out = out.withColumn(left, F.when(touched, F.filter(lines, lambda x: ~gone(x))))
    touched, kept = F.col(left).isNotNull(), F.col(left)
    n = F.coalesce(F.size(lines), F.lit(0)).cast("bigint")
    new = F.when(touched, F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    n_dropped = F.when(touched, n - F.size(kept)).otherwise(F.lit(0)).cast("bigint")
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns], n.alias("__n_lines"), n_dropped.alias("__n_dropped"))


def op7_site_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    out = drop_boilerplate(table(spark, folder, "documents", "doc_id", "source", "text"), "source")
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


OP7_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, source, text FROM documents),
lines AS (SELECT DISTINCT page, source, trim(l) AS line FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS l FROM pages) WHERE trim(l) <> ''),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
dropped AS (
  SELECT c.source, list(c.line) AS drops FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.total GROUP BY c.source),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls,
         [x for x in string_split(d.text, chr(10)) if trim(x) = '' OR NOT list_contains(coalesce(p.drops, []), trim(x))] AS kept
  FROM documents d LEFT JOIN dropped p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped,
       CASE WHEN len(ls) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
