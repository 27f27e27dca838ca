"""Distribution functions as SQL expressions that stay inside code generation; the same text runs in other SQL engines."""

from __future__ import annotations

# The published rational approximation of the normal quantile (relative error under 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# The published polynomial of the complementary error function in t = 1 / (1 + x / 2) (relative error under 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def num(x: float) -> str:
    return f"cast({x!r} as double)"


def poly(coefficients: tuple[float, ...], x: str) -> str:
    """Horner's scheme; the first coefficient is that of the highest power."""
    out = num(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {num(c)})"
    return out


def qnorm(p: str) -> str:
    """Standard normal quantile; null outside the open unit interval."""
    q = f"sqrt(-2 * ln({p}))"
    r = f"sqrt(-2 * ln(1 - {p}))"
    m = f"({p} - 0.5)"
    low = f"{poly(_C, q)} / ({poly(_D, q)} * {q} + 1)"
    high = f"-({poly(_C, r)} / ({poly(_D, r)} * {r} + 1))"
    mid = f"{poly(_A, f'({m} * {m})')} * {m} / ({poly(_B, f'({m} * {m})')} * ({m} * {m}) + 1)"
    return f"case when {p} <= 0 or {p} >= 1 or {p} is null then null when {p} < 0.02425 then {low} when {p} > 0.97575 then {high} else {mid} end"


def two_sided(z: str) -> str:
    """Two-sided normal tail of a z value."""
    x = f"(abs({z}) / sqrt(cast(2 as double)))"
    t = f"(1 / (1 + {x} / 2))"
    return f"({t} * exp(-{x} * {x} + {poly(_ERFC[::-1], t)}))"


def chi2_tail(x: str, df: int) -> str:
    """Upper tail of chi-squared: a finite sum for even degrees; for odd ones the normal tail and a finite sum."""
    if df % 2 == 0:
        terms, term = ["cast(1 as double)"], "cast(1 as double)"
        for k in range(1, df // 2):
            term = f"{term} * ({x}) / {2 * k}"
            terms.append(f"({term})")
        return f"(exp(-({x}) / 2) * ({' + '.join(terms)}))"
    out = two_sided(f"sqrt({x})")
    term = f"sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2)"
    for k in range(1, df, 2):
        out += f" + {term}"
        term = f"{term} * ({x}) / {k + 2}"
    return f"({out})"


def p_to_z(p: str, sign: str) -> str:
    """Signed z of a two-sided P; a P under 1e-307 needs ``tiny_z``."""
    return f"(sign({sign}) * abs({qnorm(f'({p} / 2)')}))"


def tiny_z(text: str, sign: str) -> str:
    """Signed z of a P given as text, by sqrt(-2 ln P): mantissa and exponent are taken apart, so no P is too small.

    Null for a P of 0 and for text that is no positive number with an exponent.
    """
    part = lambda k: f"try_cast(regexp_extract(lower({text}), '^([0-9.]+)e([-+]?[0-9]+)$', {k}) as double)"
    return f"(sign({sign}) * sqrt(-2 * (ln(nullif({part(1)}, 0)) + {part(2)} * ln(cast(10 as double)))))"
