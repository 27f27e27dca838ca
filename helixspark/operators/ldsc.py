"""LD-score regression: all trait pairs in one plan, block jackknife, sampling covariance; stratified and likelihood variants."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.linalg import CovStruct, unvech, vech, vech_pairs

# Relations: z (trait, SNP, N, Z, A1) and ld (SNP, CHR, BP, L2, wLD). A pair of a trait with itself is its heritability.
# Genome places are ranks within chromosomes plus offsets. A block's sums leave each task as one row.
STAGES = """
joined as (
    select z.trait, z.SNP, z.N, z.Z, z.A1, z.Z * z.Z as chi, ld.CHR, ld.BP, ld.L2, ld.wLD from z join ld on z.SNP = ld.SNP
    where z.N is not null and z.Z is not null and ld.L2 is not null
), cut as (
    select trait, {chisq_max} as most from joined group by trait
), kept as (
    select j.* from joined j join cut c on j.trait = c.trait where j.chi <= c.most
), pairs as (
    select a.trait as t1, b.trait as t2, a.SNP, a.CHR, a.BP, a.L2, a.wLD, a.N as n1, b.N as n2, a.chi as chi1, b.chi as chi2,
           case when a.A1 = b.A1 then a.Z * b.Z else -a.Z * b.Z end as zz
    from kept a join kept b on a.SNP = b.SNP and a.trait <= b.trait
), facts as (
    select t1, t2, count(*) as n, avg(n1) as mean_n1, avg(n2) as mean_n2, avg(chi1) as mean_chi1, avg(zz) as mean_zz,
           least(greatest({m} * (avg(chi1) - 1) / avg(L2 * n1), 0), 1) as agg1,
           least(greatest({m} * (avg(chi2) - 1) / avg(L2 * n2), 0), 1) as agg2
    from pairs group by t1, t2
), weighted as (
    select p.t1, p.t2, p.SNP, p.CHR, p.BP, p.L2, p.zz, f.n,
           1 / sqrt(2 * power(1 + agg1 * n1 / {m} * greatest(L2, 1), 2) * greatest(wLD, 1))
         + 1 / sqrt(2 * power(1 + agg2 * n2 / {m} * greatest(L2, 1), 2) * greatest(wLD, 1)) as w
    from pairs p join facts f on p.t1 = f.t1 and p.t2 = f.t2
), chromosomes as (
    select t1, t2, CHR, sum(c) over (partition by t1, t2 order by CHR) - c as before
    from (select t1, t2, CHR, count(*) as c from pairs group by t1, t2, CHR) c
), placed as (
    select w.t1, w.t2, w.CHR, w.L2, w.zz, w.w, w.n, row_number() over (partition by w.t1, w.t2, w.CHR order by w.BP, w.SNP) as r from weighted w
), blocked as (
    select p.t1, p.t2, p.L2 * p.w as x1, p.w as x2, p.zz * p.w as y,
           least({blocks} - 1, cast(floor(((r + before) * {blocks} - 1) / (n - 1)) as bigint)) as block
    from placed p join chromosomes c on p.t1 = c.t1 and p.t2 = c.t2 and p.CHR = c.CHR
), blocks as (
    select t1, t2, block, sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as d, sum(x1 * y) as e, sum(x2 * y) as f
    from blocked group by t1, t2, block
), totals as (
    select t1, t2, sum(a) as a, sum(b) as b, sum(d) as d, sum(e) as e, sum(f) as f from blocks group by t1, t2
), solved as (
    select t.t1, t.t2, (e * d - b * f) / (a * d - b * b) as slope, (a * f - b * e) / (a * d - b * b) as intercept, n,
           sqrt(mean_n1 * mean_n2) as nbar, mean_chi1, mean_zz
    from totals t join facts f on t.t1 = f.t1 and t.t2 = f.t2
), left_out as (
    select k.t1, k.t2, k.block,
           ((t.e - k.e) * (t.d - k.d) - (t.b - k.b) * (t.f - k.f)) / ((t.a - k.a) * (t.d - k.d) - (t.b - k.b) * (t.b - k.b)) as slope,
           ((t.a - k.a) * (t.f - k.f) - (t.b - k.b) * (t.e - k.e)) / ((t.a - k.a) * (t.d - k.d) - (t.b - k.b) * (t.b - k.b)) as intercept
    from blocks k join totals t on k.t1 = t.t1 and k.t2 = t.t2
), pseudo as (
    select l.t1, l.t2, l.block, {blocks} * s.slope - ({blocks} - 1) * l.slope as slope, {blocks} * s.intercept - ({blocks} - 1) * l.intercept as intercept, s.nbar
    from left_out l join solved s on l.t1 = s.t1 and l.t2 = s.t2
)
"""
ESTIMATES = """
select s.t1, s.t2, s.n, s.slope / s.nbar * {m} as s, s.intercept, sqrt(v.vs / {blocks}) / s.nbar * {m} as se, sqrt(v.vi / {blocks}) as intercept_se, s.mean_chi1, s.nbar
from solved s join (select t1, t2, var_samp(slope) as vs, var_samp(intercept) as vi from pseudo group by t1, t2) v on s.t1 = v.t1 and s.t2 = v.t2
"""
SAMPLING = """
select a.t1 as a1, a.t2 as a2, b.t1 as b1, b.t2 as b2, covar_samp(a.slope, b.slope) / (max(a.nbar) * max(b.nbar)) * {m} * {m} / {blocks} as v
from pseudo a join pseudo b on a.block = b.block group by a.t1, a.t2, b.t1, b.t2
"""


def stages(m: float, blocks: int, chisq_max: float | None = None) -> str:
    most = f"cast({chisq_max} as double)" if chisq_max else "greatest(0.001 * max(N), 80)"
    return STAGES.format(m=f"cast({m!r} as double)", blocks=blocks, chisq_max=most)


def filled(text: str, m: float, blocks: int) -> str:
    return text.format(m=f"cast({m!r} as double)", blocks=blocks)


def block_count(traits: int, asked: int = 200) -> int:
    """More than 18 traits need more blocks than entries of V."""
    return (traits + 1) * (traits + 2) // 2 + 1 if traits > 18 else asked


def run(z: DataFrame, ld: DataFrame, final: str, m: float, blocks: int = 200, chisq_max: float | None = None) -> DataFrame:
    """A query over the regression's stages. Block sums are the last step that grows with the variants."""
    return z.sparkSession.sql(f"with z as (select * from {{z}}), ld as (select * from {{ld}}), {stages(m, blocks, chisq_max)} {filled(final, m, blocks)}", z=z, ld=ld)


def liability(sample: float | None, population: float | None) -> float:
    """Factor from the observed to the liability scale; 1 for continuous traits."""
    if sample is None or population is None:
        return 1.0
    from statistics import NormalDist

    n = NormalDist()
    return population**2 * (1 - population) ** 2 / (sample * (1 - sample) * n.pdf(n.inv_cdf(1 - population)) ** 2)


def ldsc(z: DataFrame, ld: DataFrame, traits: list[str], m: float, sample_prev: list | None = None, population_prev: list | None = None, blocks: int = 200, chisq_max: float | None = None) -> CovStruct:
    """S, V, I, N and m of the traits. Block sums are kept, so that the two results need one pass."""
    k = len(traits)
    blocks = block_count(k, blocks)
    n = z.groupBy("trait").count().agg(F.min("count")).first()[0] or 0
    if n <= blocks:
        raise ValueError(f"{blocks} blocks need more than {n} variants")
    order = {t: i for i, t in enumerate(sorted(traits))}
    est = {(r.t1, r.t2): r for r in run(z, ld, ESTIMATES, m, blocks, chisq_max).collect()}
    key = lambda i, j: tuple(sorted((traits[i], traits[j]), key=order.get))
    pairs = vech_pairs(k)
    s = unvech([est[key(i, j)].s for i, j in pairs], k)
    i_ = unvech([est[key(i, j)].intercept for i, j in pairs], k)
    cov = {((r.a1, r.a2), (r.b1, r.b2)): r.v for r in run(z, ld, SAMPLING, m, blocks, chisq_max).collect()}
    v = np.array([[cov[key(*a), key(*b)] for b in pairs] for a in pairs])
    factor = np.array([liability(a, b) for a, b in zip(sample_prev or [None] * k, population_prev or [None] * k, strict=True)])
    scale = np.sqrt(np.outer(factor, factor))
    return CovStruct(s * scale, v * np.outer(vech(scale), vech(scale)), i_, list(traits), np.array([est[key(i, j)].nbar for i, j in pairs]), m)


def gram_blocks(rows: DataFrame, x: str, y: str, weight: str, block: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, block, xx, xy``: weighted cross-products of an array column with itself and with y, summed per block.

    Each task adds its rows up by block before anything is shuffled; matrices travel as arrays.
    """
    schema = ", ".join([f"{c} string" for c in by] + ["block bigint", "k int", "xx array<double>", "xy array<double>"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            pdf = b.to_pandas()
            for key, g in pdf.groupby([*by, "block"], sort=False):
                a = np.stack(g["x"].to_numpy()) * g["w"].to_numpy()[:, None]
                v = g["y"].to_numpy() * g["w"].to_numpy()
                h = held.setdefault(key if isinstance(key, tuple) else (key,), [np.zeros((a.shape[1],) * 2), np.zeros(a.shape[1])])
                h[0] += a.T @ a
                h[1] += a.T @ v
        if held:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(*k, len(h[1]), h[0].ravel(), h[1]) for k, h in held.items()], columns=[*by, "block", "k", "xx", "xy"]).astype({"k": "int32"}), preserve_index=False)

    some = rows.select(*(F.col(c).cast("string").alias(c) for c in by), F.col(block).cast("long").alias("block"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).mapInArrow(part, schema)
    keys = [*by, "block", "k"]
    total = lambda c: some.select(*keys, F.posexplode(c).alias("p", "v")).groupBy(*keys, "p").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("a")).select(*keys, F.col("a.v").alias(c))
    return total("xx").join(total("xy"), keys)


def stratified(rows: DataFrame, counts: np.ndarray, overlap: np.ndarray, blocks: int, x: str = "x", y: str = "y", weight: str = "w", block: str = "block") -> dict:
    """Stratified regression of one trait (or pair) on annotations and a constant, with a block jackknife.

    ``rows`` hold an array of LD scores per annotation, scaled by N over its mean, then 1. Gives coefficients, category
    totals by the overlap matrix, intercept and the pseudo-values' covariance.
    """
    sums = gram_blocks(rows, x, y, weight, block).orderBy("block").collect()
    k = sums[0].k
    xx = np.array([np.reshape(r.xx, (k, k)) for r in sums])
    xy = np.array([r.xy for r in sums])
    coef = np.linalg.solve(xx.sum(0), xy.sum(0))
    out = np.array([np.linalg.solve(xx.sum(0) - a, xy.sum(0) - b) for a, b in zip(xx, xy, strict=True)])
    b = len(sums)
    pseudo = b * coef - (b - 1) * out
    cov = np.cov(pseudo.T) / b
    tau = coef[:-1] * counts
    scale = np.outer(counts, counts)
    return {"tau": tau, "s": overlap @ tau, "intercept": coef[-1], "v_tau": cov[:-1, :-1] * scale, "v_s": overlap @ (cov[:-1, :-1] * scale) @ overlap.T, "prop": counts / counts[0]}


def annotation_overlap(rows: DataFrame, annotations: list[str]) -> DataFrame:
    """``a, b, overlap``: sums of products of annotation columns, one pass."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum(F.col(a) * F.col(b)).cast("double").alias("overlap")) for a in annotations for b in annotations]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def hdl_piece(b1: np.ndarray, b2: np.ndarray | None, lam: np.ndarray, n1: float, n2: float, n0: float, m: float, ref: float, rho: float = 0.0, first: tuple = (), second: tuple = ()) -> tuple[float, float]:
    """Likelihood estimate (value, intercept) of one LD piece, from effects rotated onto the LD's eigenvectors.

    One trait: heritability in [0, 1], intercept in [0, 10]. Two traits: covariance in [-1, 1], given both traits' estimates.
    """
    floor = math.exp(-18)

    def variance(h: float, i: float, n: float) -> np.ndarray:
        return np.maximum(h / m * lam**2 - h * lam / ref + i * lam / n, floor)

    if b2 is None:
        def loss(p):
            v = variance(p[0], p[1], n1)
            return float(np.log(v).sum() + (b1**2 / v).sum())

        x = np.array([min(max((np.sum(b1**2) - len(b1) / n1) / max(np.sum(lam**2) / m, 1e-12), 0.01), 0.9), 1.0])
        return tuple(bounded_min(loss, x, np.array([0.0, 0.0]), np.array([1.0, 10.0])))
    v11, v22 = variance(*first, n1), variance(*second, n2)

    def loss12(p):
        v12 = p[0] / m * lam**2 + p[1] * lam / n0 * max(n0 / max(n1, n2), 1e-12)
        v = np.maximum(v22 - v12**2 / v11, floor)
        e = b2 - v12 / v11 * b1
        return float(np.log(v).sum() + (e**2 / v).sum())

    return tuple(bounded_min(loss12, np.array([0.0, rho]), np.array([-1.0, -10.0]), np.array([1.0, 10.0])))


def bounded_min(loss, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200) -> np.ndarray:
    """Projected quasi-Newton minimum in a box, with numerical gradients and step halving."""
    x = np.clip(x, low, high)
    h = np.eye(len(x)) * 1e-3
    f = loss(x)

    def gradient(p):
        g = np.zeros(len(p))
        for j in range(len(p)):
            e = 1e-6 * (1 + abs(p[j]))
            a, b = p.copy(), p.copy()
            a[j], b[j] = min(a[j] + e, high[j]), max(b[j] - e, low[j])
            g[j] = (loss(a) - loss(b)) / (a[j] - b[j])
        return g

    g = gradient(x)
    for _ in range(steps):
        held = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))
        step = np.where(held, 0, -(h @ np.where(held, 0, g)))
        if step @ g >= 0:
            h = np.eye(len(x)) * 1e-3
            step = np.where(held, 0, -h @ g)
        t = 1.0
        while t > 1e-12:
            new = np.clip(x + t * step, low, high)
            fn = loss(new)
            if fn < f - 1e-10 * abs(t * (step @ g)):
                break
            t /= 2
        else:
            return x
        gn = gradient(new)
        s, y = new - x, gn - g
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            a = np.eye(len(x)) - r * np.outer(s, y)
            h = a @ h @ a.T + r * np.outer(s, s)
        done = np.abs(s).max() < 1e-10 or abs(f - fn) < 1e-12 * (1 + abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x


def hdl(pieces: DataFrame, traits: list[str], n: dict[str, float], m: float, ref: float) -> CovStruct:
    """Piecewise likelihood estimates. ``pieces``: ``piece, trait, b`` (rotated effects, aligned) and ``lam``; one task per pair and piece."""
    k = len(traits)
    pairs = vech_pairs(k)
    wanted = pieces.sparkSession.createDataFrame([(p, traits[i], traits[j]) for p, (i, j) in enumerate(pairs)], "pair int, t1 string, t2 string")
    x, y = pieces.select("piece", F.col("trait").alias("t1"), F.col("b").alias("b1"), "lam"), pieces.select("piece", F.col("trait").alias("t2"), F.col("b").alias("b2"))
    rows = wanted.join(x, "t1").join(y, ["piece", "t2"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                b1, b2, lam = np.asarray(r.b1), np.asarray(r.b2), np.asarray(r.lam)
                n1, n2 = n[r.t1], n[r.t2]
                one = hdl_piece(b1, None, lam, n1, n1, n1, m, ref)
                if r.t1 == r.t2:
                    out.append((r.pair, r.piece, *one))
                else:
                    two = hdl_piece(b2, None, lam, n2, n2, n2, m, ref)
                    out.append((r.pair, r.piece, *hdl_piece(b1, b2, lam, n1, n2, min(n1, n2), m, ref, 0.0, one, two)))
            yield pd.DataFrame(out, columns=["pair", "piece", "value", "intercept"])

    got = rows.repartition("pair", "piece").mapInPandas(fit, "pair int, piece int, value double, intercept double").orderBy("pair", "piece").toPandas()
    value = got.pivot(index="piece", columns="pair", values="value").to_numpy()
    inter = got.pivot(index="piece", columns="pair", values="intercept").to_numpy()
    p = len(value)
    hold = p / (p - 1) * (value.sum(0) - value)
    return CovStruct(unvech(value.sum(0), k), np.cov(hold.T).reshape(len(pairs), -1) * (p - 1), unvech(inter.mean(0), k), list(traits), None, m)


def simulate(spark: SparkSession, ld: DataFrame, cov: np.ndarray, n: list[float], m: float, intercepts: np.ndarray, replicates: int = 1, seed: int = 1) -> DataFrame:
    """``replicate, trait, SNP, N, Z``: z scores of variants with the covariance that LD scores imply.

    Seeds are hashes of the variant, so partitions don't matter.
    """
    k = len(n)
    root = np.sqrt(np.outer(n, n)) * cov / m

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in range(replicates):
                z = np.stack([np.random.default_rng([seed, r, int(h) & 0xFFFFFFFF]).standard_normal(k) for h in pdf["h"]]) if len(pdf) else np.zeros((0, k))
                sigma = root[None] * pdf["L2"].to_numpy()[:, None, None] + intercepts[None]
                w, q = np.linalg.eigh(sigma)
                out = np.einsum("nij,nj->ni", q * np.sqrt(np.maximum(w, 0))[:, None, :], z)
                for j in range(k):
                    yield pd.DataFrame({"replicate": r, "trait": f"T{j + 1}", "SNP": pdf["SNP"], "N": float(n[j]), "Z": out[:, j]})

    return ld.select("SNP", "L2", F.xxhash64("SNP").alias("h")).mapInPandas(draw, "replicate int, trait string, SNP string, N double, Z double")


def parallel_analysis(spark: SparkSession, cov: CovStruct, draws: int = 500, quantile: float = 0.95, diagonal: bool = False, seed: int = 1) -> DataFrame:
    """``component, observed, simulated, difference``: eigenvalues of the correlations against those of null draws."""
    r, v = cov.standardized()
    k = len(r)
    w, q = np.linalg.eigh(np.diag(np.diag(v)) if diagonal else v)
    half = q * np.sqrt(np.maximum(w, 0))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                null = vech(np.eye(k)) + half @ np.random.default_rng([seed, int(i)]).standard_normal(len(half))
                values = np.sort(np.linalg.eigvalsh(unvech(null, k)))[::-1]
                yield pd.DataFrame({"component": np.arange(1, k + 1), "value": values})

    null = spark.range(draws).mapInPandas(draw, "component int, value double").groupBy("component").agg(F.expr(f"percentile(value, {quantile})").alias("simulated"))
    seen = spark.createDataFrame([(j + 1, float(x)) for j, x in enumerate(np.sort(np.linalg.eigvalsh(r))[::-1])], "component int, observed double")
    return seen.join(null, "component").withColumn("difference", F.col("observed") - F.col("simulated"))
