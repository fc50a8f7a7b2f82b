"""SQL fragments for the checking engine: tail probabilities by numerical integration.

They share nothing with the library's own formulas, so equal results mean something.
"""

from __future__ import annotations

from ..functions import tails

STEPS = 2000


def _simpson(low: str, high: str, density: str) -> str:
    """Simpson sum of ``density`` (text in ``{x}``) between two expressions."""
    width = f"((({high}) - ({low})) / {STEPS}.0)"
    x = f"(({low}) + i * {width})"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {weight} * ({density.format(x=x)})))"
            f" * {width} / 3)")


def t_p(t: str, v: str) -> str:
    low = f"atan(abs({t}) / sqrt({v}))"
    high = f"least(pi() / 2, {low} + 40 / sqrt({v}))"
    area = _simpson(low, high, f"exp(({v} - 1) * ln(greatest(cos({{x}}), 1e-300)))")
    return f"(2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi()) * {area})"


def f_p(f: str, d1: str, d2: str) -> str:
    low = f"asin(sqrt({d1} * {f} / ({d1} * {f} + {d2})))"
    high = f"least(pi() / 2, {low} + 40 / sqrt({d2}))"
    area = _simpson(low, high, f"exp(({d1} - 1) * ln(greatest(sin({{x}}), 1e-300)) + ({d2} - 1) * ln(greatest(cos({{x}}), 1e-300)))")
    return f"(2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)) * {area})"


def chi2_p(x: str, k: str) -> str:
    low = f"sqrt({x})"
    high = f"(greatest({low}, sqrt({k})) + 12)"
    area = _simpson(low, high, f"exp(({k} - 1) * ln(greatest({{x}}, 1e-300)) - {{x}} * {{x}} / 2)")
    return f"(2 * exp(-({k} / 2.0) * ln(2) - lgamma({k} / 2.0)) * {area})"


def normal_two_sided_p(z: str) -> str:
    return chi2_p(f"({z}) * ({z})", "1")


def normal_upper_p(z: str) -> str:
    both = normal_two_sided_p(z)
    return f"(CASE WHEN {z} >= 0 THEN {both} / 2 ELSE 1 - {both} / 2 END)"


def _poly(x: str, coefficients) -> str:
    out = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {float(c)!r})"
    return out


def normal_quantile(p: str) -> str:
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    ratio = lambda pair, x: f"({_poly(x, pair[0])} / {_poly(x, pair[1])})"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(tails.QUANTILE_CENTRE, f'(0.180625 - {q} * {q})')}"
            f" WHEN {r} <= 5 THEN sign({q}) * {ratio(tails.QUANTILE_MIDDLE, f'({r} - 1.6)')}"
            f" ELSE sign({q}) * {ratio(tails.QUANTILE_TAIL, f'({r} - 5)')} END)")


def uniform(seed, *ids: str) -> str:
    """The seeded number of operators.sampling.uniform."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5) / {16 ** 12}.0)"
