"""Per-variant scans: V_SNP and S_Full as expressions, the closed-form single-factor scan, and Arrow-batched model fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.functions import expr
from helixspark.functions.linalg import CovStruct, chi2_tail, two_sided
from helixspark.operators.sem import Model, fit_batch

num = expr.num


def gc_factor(i: np.ndarray, gc: str) -> np.ndarray:
    """Genomic-control factor by trait: the intercept, its root or 1; intercepts under 1 count as 1."""
    d = np.maximum(np.diag(i), 1)
    return {"conserv": d, "standard": np.sqrt(d), "none": np.ones_like(d)}[gc]


def v_snp(cov: CovStruct, gc: str = "standard", se: str = "se_{}", var: str = "varSNP") -> list[list[str]]:
    """Expressions of the variant's sampling covariance over the traits."""
    g, k = gc_factor(cov.i, gc), len(cov.names)
    se_of = [se.format(t) for t in cov.names]
    cell = lambda a, b: f"({se_of[a]} * {se_of[b]} * {num(float((1 if a == b else cov.i[a, b]) * g[a] * g[b]))} * {var} * {var})"
    return [[cell(a, b) for b in range(k)] for a in range(k)]


def s_full(cov: CovStruct, beta: str = "beta_{}", var: str = "varSNP") -> list[str]:
    """Expressions of the lower triangle, by columns, of the covariance of the variant and the traits."""
    k = len(cov.names)
    first = [var] + [f"({var} * {beta.format(t)})" for t in cov.names]
    return first + [num(float(cov.s[i, j])) for j in range(k) for i in range(j, k)]


def z_pre(cov: CovStruct, gc: str = "standard", beta: str = "beta_{}", se: str = "se_{}") -> list[str]:
    return [f"({beta.format(t)} / ({se.format(t)} * {num(float(g))}))" for t, g in zip(cov.names, gc_factor(cov.i, gc), strict=True)]


def with_matrices(variants: DataFrame, cov: CovStruct, gc: str = "standard", var: str = "2 * MAF * (1 - MAF)") -> DataFrame:
    """The rows with ``s_full`` and ``v_snp``, lower triangles by columns, of the variant (or, with HSQ as ``var``, gene) and the traits."""
    cells, k = v_snp(cov, gc, var="__var"), len(cov.names)
    rows = variants.withColumn("__var", F.expr(var))
    lower = ", ".join(cells[i][j] for j in range(k) for i in range(j, k))
    return rows.withColumns({"s_full": F.expr(f"array({', '.join(s_full(cov, var='__var'))})"), "v_snp": F.expr(f"array({lower})")}).drop("__var")


def inverse3(m: list[list[str]]) -> tuple[list[list[str]], str]:
    """Cofactors and determinant of a symmetric 3 x 3 matrix of expressions."""
    c = lambda a, b: f"({m[(a + 1) % 3][(b + 1) % 3]} * {m[(a + 2) % 3][(b + 2) % 3]} - {m[(a + 1) % 3][(b + 2) % 3]} * {m[(a + 2) % 3][(b + 1) % 3]})"
    cof = [[c(a, b) for b in range(3)] for a in range(3)]
    return cof, f"({' + '.join(f'{m[0][b]} * {cof[0][b]}' for b in range(3))})"


def single_factor_sql(cov: CovStruct, loadings: np.ndarray, source: str, gc: str = "standard", var_se: float = 5e-4, keys: str = "SNP, CHR, BP, MAF, A1, A2") -> str:
    """The scan of one factor with a fixed measurement model, as one query over ``source``: no function leaves code generation.

    The variant's path is a weighted least-squares projection of the traits' covariances on the loadings; Q_SNP is what the
    projection leaves, in the metric of the inverse V_SNP (for three traits).
    """
    k = len(cov.names)
    v = [[f"v{min(a, b)}{max(a, b)}" for b in range(k)] for a in range(k)]
    cells = v_snp(cov, gc)
    vs = ", ".join(f"{cells[a][b]} as v{a}{b}" for a in range(k) for b in range(a, k))
    top = " + ".join(f"{num(float(x))} * s{j} / v{j}{j}" for j, x in enumerate(loadings))
    low = " + ".join(f"{num(float(x * x))} / v{j}{j}" for j, x in enumerate(loadings))
    meat = " + ".join(f"{num(float(loadings[a] * loadings[b]))} * {v[a][b]} / (v{a}{a} * v{b}{b})" for a in range(k) for b in range(k))
    cof, det = inverse3(v)
    q = " + ".join(f"r{a} * r{b} * {cof[a][b]}" for a in range(3) for b in range(3))
    return f"""
select {keys}, b as est, se, b / se as z, {expr.two_sided("b / se")} as pval, q as q_snp, {k - 1} as q_snp_df, {expr.chi2_tail("q", k - 1)} as q_snp_pval
from (
    select *, c / varSNP as b, sqrt(meat / (low * low) / (varSNP * varSNP) + c * c / power(varSNP, 4) * {num(var_se**2)}) as se, ({q}) / {det} as q
    from (
        select *, {", ".join(f"s{j} - c * {num(float(x))} as r{j}" for j, x in enumerate(loadings))}
        from (
            select *, ({top}) / ({low}) as c, {low} as low, {meat} as meat
            from (select *, {", ".join(f"varSNP * beta_{t} as s{j}" for j, t in enumerate(cov.names))}, {vs}
                  from (select *, 2 * MAF * (1 - MAF) as varSNP from {source}) x) y
        ) w
    ) u
) t
"""


def single_factor_scan(variants: DataFrame, cov: CovStruct, loadings: np.ndarray, gc: str = "standard", var_se: float = 5e-4) -> DataFrame:
    if len(cov.names) != 3:
        return user_gwas(variants, cov, f"F1 =~ {' + '.join(cov.names)}\nF1 ~ SNP", gc, var_se)
    return variants.sparkSession.sql(single_factor_sql(cov, loadings, "{variants}", gc, var_se), variants=variants)


def user_gwas(variants: DataFrame, cov: CovStruct, model: str, gc: str = "standard", var_se: float = 5e-4, fix_measurement: bool = True, q_snp: bool = True, keep: list[tuple[str, str, str]] | None = None, keys: tuple[str, ...] = ("SNP", "CHR", "BP", "MAF", "A1", "A2")) -> DataFrame:
    """Any model of the traits and ``SNP``, for each variant: one long table of parameters with SEs, fit and status.

    The model is compiled once (and its measurement part fitted once); batches of variants are fitted together by weighted
    Gauss-Newton. A variant that fails has a status instead of an estimate; it doesn't stop the others.
    """
    spec = Model.parse(model, ["SNP", *cov.names])
    if fix_measurement:
        spec = spec.measurement_fixed(cov)
    g = gc_factor(cov.i, gc)
    inter = cov.i.copy()
    np.fill_diagonal(inter, 1)
    names, free = cov.names, [p for p in spec.rows if p.free]
    shown = [j for j, p in enumerate(free) if keep is None or (p.lhs, p.op, p.rhs) in keep]
    factor = next((p.lhs for p in spec.rows if p.op == "~" and p.rhs == "SNP" and p.lhs not in names), None)
    loads = {p.rhs: j for j, p in enumerate(spec.rows) if p.op == "=~" and p.lhs == factor}
    schema = ", ".join([*(f"{c} {t}" for c, t in variants.select(*keys).dtypes), "lhs string", "op string", "rhs string", "est double", "se double", "z double", "pval double", "chisq double", "chisq_df int", "chisq_pval double", "aic double", "q_snp double", "q_snp_df int", "q_snp_pval double", "status string"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                if not len(part):
                    continue
                b = part[[f"beta_{t}" for t in names]].to_numpy()
                e = part[[f"se_{t}" for t in names]].to_numpy()
                var = 2 * part["MAF"].to_numpy() * (1 - part["MAF"].to_numpy())
                n, k = b.shape
                s = np.empty((n, k + 1, k + 1))
                s[:, 0, 0] = var
                s[:, 0, 1:] = s[:, 1:, 0] = var[:, None] * b
                s[:, 1:, 1:] = cov.s
                sd = e * g * var[:, None]
                vs = sd[:, :, None] * sd[:, None, :] * inter
                r = fit_batch(spec, s, vs, cov.v, np.full(n, var_se**2))
                df = (k + 1) * (k + 2) // 2 - len(free)
                q = np.full(n, np.nan)
                if q_snp and factor and len(loads) > 1:
                    on = [names.index(t) for t in loads]
                    rest = r["residual"][:, 0, 1:][:, on]
                    q = np.einsum("ni,ni->n", rest, np.linalg.solve(vs[:, on][:, :, on], rest[:, :, None])[:, :, 0])
                out = []
                for j in shown:
                    p = free[j]
                    x = part[list(keys)].copy()
                    est, se = r["est"][:, j], r["se"][:, j]
                    z = est / se
                    x["lhs"], x["op"], x["rhs"], x["est"], x["se"], x["z"] = p.lhs, p.op, p.rhs, est, se, z
                    x["pval"] = [two_sided(t) for t in z]
                    x["chisq"], x["chisq_df"] = r["chisq"], df
                    x["chisq_pval"] = [chi2_tail(t, df) if df > 0 else np.nan for t in r["chisq"]]
                    x["aic"], x["q_snp"], x["q_snp_df"] = r["chisq"] + 2 * len(free), q, max(len(loads) - 1, 0)
                    x["q_snp_pval"] = [chi2_tail(t, len(loads) - 1) if t == t else np.nan for t in q]
                    x["status"] = np.where(r["converged"], "ok", "not converged")
                    out.append(x)
                yield pd.concat(out)

    need = [*keys, *(f"{c}_{t}" for t in names for c in ("beta", "se"))]
    return variants.select(*dict.fromkeys(need)).mapInPandas(fit, schema)


def common_factor_gwas(variants: DataFrame, cov: CovStruct, gc: str = "standard", var_se: float = 5e-4) -> DataFrame:
    """One factor with free loadings (the first is 1) and the variant's path on it; Q from what the path leaves."""
    out = user_gwas(variants, cov, f"F1 =~ 1*{cov.names[0]} + {' + '.join(cov.names[1:])}\nF1 ~ SNP", gc, var_se, False, True, [("F1", "~", "SNP")])
    return out.select("SNP", "CHR", "BP", "MAF", "A1", "A2", "lhs", "op", "rhs", "est", F.col("se").alias("se_c"), F.col("z").alias("Z_Estimate"), F.col("pval").alias("Pval_Estimate"), F.col("q_snp").alias("Q"), F.col("q_snp_df").alias("Q_df"), F.col("q_snp_pval").alias("Q_pval"), "status")
