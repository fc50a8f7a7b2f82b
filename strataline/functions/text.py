"""Text to flags, codes and numbers. Every function returns a Column; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .missing import column, if_else3, number


def keyword_flag(c: str | Column, words: Iterable[str], hit: int = 1, miss: int = 0) -> Column:
    """1 where any of the patterns occurs, 0 where none does, NULL where the text is missing."""
    return if_else3(column(c).rlike("|".join(words)), F.lit(hit), F.lit(miss))


def history_flags(history: str | Column, words: Mapping[str, Iterable[str]] = V.HISTORY_WORDS):
    return {name: keyword_flag(history, w) for name, w in words.items()}


def risk_flags(smoking, family_history, apoe, history) -> dict[str, Column]:
    """The eight risk flags of a registry row."""
    apoe = column(apoe)
    return {
        "smoking": keyword_flag(smoking, V.SMOKER),
        "family_history_dementia": keyword_flag(family_history, V.NO_FAMILY_HISTORY, 0, 1),
        "apoe_e4": F.when(apoe.rlike("E4"), 1).when(apoe.rlike("ND"), None)
        .when(apoe.isNotNull(), 0),
        **history_flags(history),
    }


def lookup_number(text: str | Column, rules: Sequence[tuple[str, float]], existing=None) -> Column:
    """Existing value, else the text read as a whole number, else the first matching rule."""
    text = column(text)
    ruled = F.lit(None).cast("double")
    for pattern, value in reversed(list(rules)):
        ruled = F.when(text.rlike(pattern), F.lit(float(value))).otherwise(ruled)
    digits = F.when(text.rlike(r"^\d+$"), number(text))
    parts = [digits, ruled]
    return F.coalesce(*([column(existing).cast("double")] if existing is not None else []), *parts)


def education_years(text, existing=None) -> Column:
    return lookup_number(text, V.SCHOOLING_YEARS, existing)


def recode(c: str | Column, mapping: Mapping, default=None, keep: bool = True) -> Column:
    """Replace listed values; others stay (``keep``) or take ``default``."""
    c = column(c)
    out = c if keep else F.lit(default)
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def no_yes_unknown(flag: str | Column) -> Column:
    """0 to 1, 1 to 2, everything else (missing too) to 3."""
    flag = column(flag)
    return F.when(flag == 0, 1).when(flag == 1, 2).otherwise(3)


def matches(c: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    return column(c).rlike(("(?i)" if ignore_case else "") + pattern)


def answered(c: str | Column, yes: str, no: str | None = None) -> Column:
    """Ignore-case answer coding: yes 1, no 0, other NULL; without ``no`` everything else is 0."""
    c = column(c)
    hit = F.when(F.coalesce(matches(c, yes, True), F.lit(False)), 1)
    return hit.otherwise(0) if no is None else hit.when(matches(c, no, True), 0)


def replace_first(c: str | Column, pattern: str, text: str) -> Column:
    return F.regexp_replace(column(c), f"(?s)^(.*?)(?:{pattern})", "$1" + text)


def replace_all(c: str | Column, pattern: str, text: str) -> Column:
    return F.regexp_replace(column(c), pattern, text)


def remove_first(c: str | Column, pattern: str) -> Column:
    return replace_first(c, pattern, "")


def remove_all(c: str | Column, pattern: str) -> Column:
    return replace_all(c, pattern, "")


def extract(c: str | Column, pattern: str, group: int = 0) -> Column:
    """First match, NULL where there is none."""
    found = F.regexp_extract(column(c), pattern, group)
    return F.when(found != "", found)


def drop_first_char(c: str | Column) -> Column:
    c = column(c)
    return c.substr(F.lit(2), F.length(c))


def pieces(c: str | Column, separator: str = "\n") -> Column:
    """Number of values packed in one cell."""
    c = column(c)
    return F.when(c.isNotNull(), F.size(F.split(c, separator)))


def paste(*cs: str | Column, sep: str = "", missing: str | None = None) -> Column:
    """Join texts; NULL if any part is, unless ``missing`` names the text to use for it."""
    parts = [column(c).cast("string") for c in cs]
    if missing is not None:
        parts = [F.coalesce(p, F.lit(missing)) for p in parts]
    if not sep:
        return F.concat(*parts)
    spaced: list[Column] = []
    for i, p in enumerate(parts):
        spaced += [p] if i == 0 else [F.lit(sep), p]
    return F.concat(*spaced)


def split_fields(c: str | Column, names: Sequence[str], separator: str) -> dict[str, Column]:
    """One column into several by position; a missing part is NULL."""
    parts = F.split(column(c), separator)
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}


def allele_pair(c: str | Column) -> Column:
    """``e3e4`` to ``E3/E4``."""
    return F.regexp_replace(F.upper(column(c)), r"^(E\d)(E\d)$", "$1/$2")


def line_union(x: str | Column, y: str | Column, separator: str = "\n") -> Column:
    """Lines of x, then the new lines of y."""
    x, y = column(x).cast("string"), column(y).cast("string")
    return F.array_join(F.array_distinct(F.concat(F.split(x, separator), F.split(y, separator))),
                        separator)


def merge_cells(x: str | Column, y: str | Column) -> Column:
    """Both missing: NULL. One missing: the other. Equal: that value. Different: union of lines."""
    x, y = column(x), column(y)
    return F.when(x.isNull(), y).when(y.isNull() | (x == y), x).otherwise(line_union(x, y))


def relative_code(c: str | Column) -> Column:
    """Digits of the relatives named in the text; mother and father together become one digit."""
    c = column(c)
    digits = [F.when(c.rlike("|".join(words)), code).otherwise("")
              for words, code in V.RELATIVE_WORDS]
    return F.when(c.isNotNull(), replace_first(F.concat(*digits), *V.BOTH_PARENTS))


def money(c: str | Column) -> Column:
    """Free-text amounts to whole currency units; amounts below 10000 are in units of 10000."""
    c = remove_first(c, "원[가-힣]*")
    c = replace_first(c, "만", "0000")
    c = replace_first(c, "원", "000")
    amount = number(remove_all(c, r"[\p{L}\s?]")).try_cast("bigint")
    return F.when(amount < 10000, amount * 10000).otherwise(amount)


def carrier(variant: str | Column, allele: str) -> Column:
    """1 where the changed part of ``ref>alt`` text names the allele; 0 for a normal call."""
    variant = column(variant)
    changed = variant.substr(F.lit(3), F.length(variant))
    return if_else3((variant != V.NORMAL) & changed.contains(allele), F.lit(1), F.lit(0))


def homozygote(variant: str | Column, allele: str) -> Column:
    return carrier(variant, f"{allele}/{allele}")


def allele_carrier(genotype: str | Column, allele: str) -> Column:
    return if_else3(column(genotype).contains(allele), F.lit(1), F.lit(0))


def allele_homozygote(genotype: str | Column, allele: str) -> Column:
    return if_else3(column(genotype) == f"{allele}/{allele}", F.lit(1), F.lit(0))


def any_flag(*cs: str | Column) -> Column:
    """Three-valued OR over 0/1 flags: 1 beats missing, missing beats 0."""
    hit = None
    for c in cs:
        term = column(c) == 1
        hit = term if hit is None else hit | term
    return if_else3(hit, F.lit(1), F.lit(0))


def flag_sum(*cs: str | Column) -> Column:
    total = column(cs[0])
    for c in cs[1:]:
        total = total + column(c)
    return total


def all_flags(*cs: str | Column) -> Column:
    """1 when the flags sum to their number; missing if any flag is."""
    return if_else3(flag_sum(*cs) == len(cs), F.lit(1), F.lit(0))


def some_flags(*cs: str | Column) -> Column:
    """1 when the flags sum to one or more; missing if any flag is."""
    return if_else3(flag_sum(*cs) >= 1, F.lit(1), F.lit(0))
