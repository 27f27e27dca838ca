"""Mixing sources to target weights: soft membership of domains, then the document rates nearest to 1 that meet them.

A naive Bayes classifier, fitted to a labelled table, gives each document a posterior over domains. Nonnegative rates make the
expected tokens of each domain meet targets. All of it is in DataFrame functions.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm._common import stored, table

#: At most about so many labelled rows fit the classifier; word buckets; words whose mean evidence a document counts for.
TRAIN_ROWS, BUCKETS, SHARPNESS = 6000, 4096, 60
#: Largest error of a domain's tokens, as a share of all; passes that a solution may take before it counts as out of reach.
TOLERANCE, PASSES = 1e-6, 40
#: By how much more than the least total a corpus that keeps every document may grow, tried in turn.
GROWN = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


def buckets(text_col: str) -> F.Column:
    """Buckets of a text's words, runs of letters and digits in lower case."""
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit(labelled: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[list[str], list[list[int]], list[int]]:
    """Domains, and for each its log likelihoods by bucket and log prior, in thousandths.

    ``labelled`` has ``doc_id``, a text and ``domain``; rows with a null one don't count. A hash of the id picks about
    ``rows`` of them. Domains must be few: their counts by bucket come to the driver.
    """
    some = labelled.where("domain is not null and doc_id is not null")
    n = some.count()
    if n > rows:
        some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    counts = some.select("domain", F.explode(buckets(text_col)).alias("b")).groupBy("domain", "b").count().collect()
    names = [r[0] for r in some.groupBy("domain").count().orderBy("domain").collect()]
    sizes = dict(some.groupBy("domain").count().collect())
    table_ = np.ones((len(names), BUCKETS))
    for d, b, c in counts:
        table_[names.index(d), b] += c
    likely = np.log(table_ / table_.sum(1, keepdims=True)) if names else table_
    return names, np.rint(1000 * likely).astype(int).tolist(), [round(1000 * math.log(sizes[d] / sum(sizes.values()))) for d in names]


def with_posterior(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """The rows with ``__n`` (words) and ``__p0, __p1, ...`` (posterior of each domain). A text without words has the prior."""
    names, likely, prior = model
    k = len(names)
    literal = ["array(" + ",".join(map(str, r)) + ")" for r in likely]
    start = "named_struct(" + ", ".join(f"'s{i}', 0L" for i in range(k)) + ")"
    step = "named_struct(" + ", ".join(f"'s{i}', s.s{i} + get({literal[i]}, b)" for i in range(k)) + ")"
    out = docs.withColumn("__b", buckets(text_col)).withColumn("__n", F.size("__b").cast("long"))
    out = out.withColumn("__s", F.expr(f"aggregate(__b, {start}, (s, b) -> {step})")).drop("__b")
    weight = F.least(F.col("__n"), F.lit(SHARPNESS)) / F.greatest(F.col("__n"), F.lit(1)) / 1000.0
    out = out.withColumns({f"__l{i}": F.col(f"__s.s{i}") * weight + prior[i] / 1000 for i in range(k)}).drop("__s")
    top = F.greatest(*(F.col(f"__l{i}") for i in range(k))) if k > 1 else F.col("__l0")
    out = out.withColumn("__t", top).withColumns({f"__e{i}": F.exp(F.col(f"__l{i}") - F.col("__t")) for i in range(k)})
    total = sum((F.col(f"__e{i}") for i in range(k)), F.lit(0.0))
    return out.withColumns({f"__p{i}": F.col(f"__e{i}") / total for i in range(k)}).drop("__t", *(f"__{x}{i}" for x in "le" for i in range(k)))


def rate(pull: list[float], least: float) -> F.Column:
    """A document's rate: 1 less its words times the sum of ``pull`` over its domains, but not under ``least``."""
    return F.greatest(F.lit(least), F.lit(1.0) - F.col("__n") * sum((F.col(f"__p{i}") * F.lit(float(x)) for i, x in enumerate(pull)), F.lit(0.0)))


def solved(members: DataFrame, target: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The ``pull`` under which the expected tokens of each domain meet ``target``, and the largest error left.

    The rates nearest to 1 (in squares) that meet the targets are 1 + a sum over the document's domains, clipped: a projected
    gradient's form. Newton steps on the dual, with the Gram matrix of the rows not clipped, find that sum; a step is halved
    until the dual falls. A pass is one aggregation.
    """
    k = len(target)
    p = [F.col(f"__p{i}") * F.col("__n") for i in range(k)]
    total = target.sum()

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        free = (F.lit(1.0) - sum((p[i] * F.lit(float(y[i])) for i in range(k)), F.lit(0.0))) >= least
        some = members.select("*", rate(list(y), least).alias("__r"), free.cast("double").alias("__f"))
        row = some.agg(F.sum(F.col("__r") * F.col("__r") - 2 * F.col("__r") * (1 - sum((p[i] * F.lit(float(y[i])) for i in range(k)), F.lit(0.0)))).alias("v"), *(F.sum(F.col("__r") * p[i]).alias(f"t{i}") for i in range(k)), *(F.sum(F.col("__f") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        # The dual to be made least: minus half of the least of |r|^2 - 2 r (1 - n p y), plus the targets' y.
        return -row["v"] / 2 + float(target @ y), np.array([float(row[f"t{i}"]) for i in range(k)]), gram

    pull = np.zeros(k)
    best = (math.inf, pull)
    value, now, gram = at(pull)
    ridge = 1e-12 * np.trace(gram) / k * np.eye(k)
    for _ in range(PASSES):
        error = float(np.abs(now - target).max()) / total
        best = min(best, (error, pull), key=lambda x: x[0])
        if error <= TOLERANCE:
            break
        step = np.linalg.solve(gram + ridge, now - target)
        size = 1.0
        while True:
            new = at(pull + size * step)
            # Near the end the dual's rounding hides its fall: a smaller error will do.
            if new[0] <= value + 1e-4 * size * float((target - now) @ step) or np.abs(new[1] - target).max() < 0.9 * np.abs(now - target).max():
                break
            size /= 4
            if size < 1e-6:
                return best[1], best[0]
        pull, (value, now, gram) = pull + size * step, new
    return best[1], best[0]


def fit_rates(members: DataFrame, targets: list[float] | None, least: float = 0.0, power: float = 0.8) -> list[float]:
    """The ``pull`` of ``rate`` that makes the domains' expected tokens meet the targets.

    ``targets`` are shares; the total stays that of the corpus, or with a least rate of 1 grows until no domain need shrink,
    and on until the targets can be met: a document that is repeated for one domain adds a little to the others.
    None stands for the present shares to the ``power``, made to add up to 1. What can't be met is warned of, with the error.
    """
    k = sum(c.startswith("__p") for c in members.columns)
    row = members.agg(*(F.sum(F.col(f"__p{i}") * F.col("__n")).alias(f"t{i}") for i in range(k))).first()
    if row is None or row[0] is None or sum(row) == 0:
        return [0.0] * k
    now = np.array([float(x) for x in row])
    if targets is None or sum(targets) == 0:
        targets = (now / now.sum()) ** power
    share = np.array(targets, float) / sum(targets)
    total = max(now[share > 0] / share[share > 0]) if least >= 1 else now.sum()
    for grown in GROWN if least >= 1 else (0.0,):
        pull, error = solved(members, share * total * (1 + grown), least)
        if error <= TOLERANCE:
            break
    if error > TOLERANCE:
        warnings.warn(f"mixing misses its targets by up to {error:.2e} of all tokens", stacklevel=2)
    return pull.tolist()


def memberships(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    k = len(model[0])
    return with_posterior(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model).select("doc_id", "__n", *(f"__p{i}" for i in range(k)))


def domain_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table: quality and toxicity together name a domain; the largest counts where an id repeats."""
    named = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.concat(F.lit("quality"), "quality", F.lit("_toxic"), "toxic")).alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """``doc_id, n_words, domain_posterior`` (by domain's name order) and ``rate`` of each row.

    A null text has no words, the prior's posterior and rate 1; null ids stay null; rows that repeat are rows of their own.
    Without labels there are no domains and every rate is 1. An empty table gives an empty result.
    """
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(domain_of(labels), "doc_id"))
    names = model[0]
    if not names:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(buckets("text")).cast("long").alias("n_words"), F.array().cast("array<double>").alias("domain_posterior"), F.lit(1.0).alias("rate"))
    members = stored(memberships(docs, model), "members")
    pull = fit_rates(members, [targets.get(x, 0.0) for x in names] if targets else None, least)
    return members.select("doc_id", F.col("__n").alias("n_words"), F.array(*(F.col(f"__p{i}") for i in range(len(names)))).alias("domain_posterior"), rate(pull, least).alias("rate"))


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The input's rows, each repeated by its rate: at least once, and once more as a hash of the id falls below the fraction."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(domain_of(labels), "doc_id"))
    names = model[0]
    if not names:
        return docs
    members = stored(memberships(docs, model), "members")
    pull = fit_rates(members, [targets.get(x, 0.0) for x in names] if targets else None, 1.0)
    out = with_posterior(docs, model).withColumn("__r", rate(pull, 1.0))
    drawn = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.floor(F.col("__r") + drawn).cast("int")))).select(*docs.columns)


#: Shares that a corpus for general training asks for: mostly clean and good, little of the rest.
TARGETS = {"quality1_toxic0": 0.8, "quality0_toxic0": 0.14, "quality1_toxic1": 0.04, "quality0_toxic1": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
