"""Structural equation models of small covariance matrices: parser, implied moments, fits, standard errors, fit indices."""

from __future__ import annotations

import ast
import operator
import re
from dataclasses import dataclass, replace

import numpy as np

from helixspark.functions.linalg import CovStruct, chi2_tail, nearest_positive, two_sided, unvech, vech, vech_pairs


@dataclass
class Row:
    """A parameter: ``lhs op rhs``, its number among the free ones (from 1; 0 is fixed), its value, label and bounds."""

    lhs: str
    op: str
    rhs: str
    free: int = 0
    value: float = 0.0
    label: str = ""
    lower: float = -np.inf
    upper: float = np.inf


@dataclass
class Model:
    observed: list[str]
    latent: list[str]
    rows: list[Row]
    defined: list[tuple[str, str]]

    @classmethod
    def parse(cls, text: str, observed: list[str], std_lv: bool = False) -> Model:
        """``=~``, ``~``, ``~~``, ``:=``, ``==`` between labels, bounds on labels; terms are ``x``, ``2*x``, ``NA*x``, ``label*x``, ``start(2)*x``.

        A factor's first loading is fixed to 1 unless one of its loadings is fixed, ``std_lv`` is set or its variance is fixed.
        Missing variances are added; factors without an incoming path covary unless that is stated.
        """
        rows: list[Row] = []
        defined, equal, bounds = [], [], []
        first_free: set[tuple[str, str, str]] = set()
        for line in re.split(r"[\n;]", text):
            line = line.split("#")[0].strip()
            if not line:
                continue
            if ":=" in line:
                defined.append(tuple(x.strip() for x in line.split(":=")))
                continue
            if "==" in line:
                equal.append(tuple(x.strip() for x in line.split("==")))
                continue
            if m := re.fullmatch(r"(\w+)\s*([<>])\s*(-?[\d.eE+-]+)", line):
                bounds.append(m.groups())
                continue
            op = next(o for o in ("=~", "~~", "~") if o in line)
            left, right = line.split(op, 1)
            for lhs in (x.strip() for x in left.split("+")):
                for term in (x.strip() for x in right.split("+")):
                    r = Row(lhs, op, term, free=-1, value=np.nan)
                    *mods, r.rhs = (x.strip() for x in term.split("*"))
                    for mod in mods:
                        if mod == "NA":
                            first_free.add((lhs, op, r.rhs))
                        elif m := re.fullmatch(r"start\((.*)\)", mod):
                            r.value = float(m[1])
                        elif re.fullmatch(r"-?[\d.]+(?:[eE][+-]?\d+)?", mod):
                            r.free, r.value = 0, float(mod)
                        else:
                            r.label = mod
                    old = next((o for o in rows if (o.lhs, o.op, o.rhs) == (r.lhs, r.op, r.rhs)), None)
                    if old:
                        old.label = r.label or old.label
                        if r.free == 0:
                            old.free, old.value = 0, r.value
                    else:
                        rows.append(r)
        latent = list(dict.fromkeys(r.lhs for r in rows if r.op == "=~"))
        used = {x for r in rows for x in (r.lhs, r.rhs)} - set(latent)
        names = [x for x in observed if x in used]
        if unknown := used - set(observed):
            raise ValueError(f"unknown variables: {', '.join(sorted(unknown))}")
        has = {(r.op, *sorted((r.lhs, r.rhs))): r for r in rows if r.op == "~~"}
        for f in latent:
            own = [r for r in rows if r.op == "=~" and r.lhs == f]
            var = has.get(("~~", f, f))
            if std_lv and not var:
                rows.append(Row(f, "~~", f, 0, 1.0))
                has["~~", f, f] = rows[-1]
            elif not (var and var.free == 0) and all(r.free for r in own) and not any((f, "=~", r.rhs) in first_free for r in own):
                own[0].free, own[0].value = 0, 1.0
        for x in [*names, *latent]:
            if ("~~", x, x) not in has:
                rows.append(Row(x, "~~", x, -1, np.nan))
        caused = {r.lhs for r in rows if r.op == "~"} | {r.rhs for r in rows if r.op == "=~"}
        free_factors = [f for f in latent if f not in caused]
        for a, x in enumerate(free_factors):
            for y in free_factors[a + 1 :]:
                if ("~~", *sorted((x, y))) not in has:
                    rows.append(Row(x, "~~", y, -1, np.nan))
        numbers: dict[str, int] = {}
        same = {b: a for a, b in equal}
        n = 0
        for r in rows:
            if r.free:
                key = same.get(r.label, r.label)
                if key and key in numbers:
                    r.free = numbers[key]
                else:
                    n += 1
                    r.free = n
                    if key:
                        numbers[key] = n
            for label, sign, x in bounds:
                if r.label == label:
                    r.lower, r.upper = (float(x), r.upper) if sign == ">" else (r.lower, float(x))
        return cls(names, latent, rows, defined)

    @property
    def count(self) -> int:
        return max((r.free for r in self.rows), default=0)

    def compiled(self) -> tuple[np.ndarray, ...]:
        """Kinds, places and numbers of the parameters in B (paths) and Psi (covariances), over observed then latent."""
        at = {x: i for i, x in enumerate([*self.observed, *self.latent])}
        kind, i, j, free, value = [], [], [], [], []
        for r in self.rows:
            a, b = (r.rhs, r.lhs) if r.op == "=~" else (r.lhs, r.rhs)
            kind.append(r.op == "~~")
            i.append(at[a])
            j.append(at[b])
            free.append(r.free)
            value.append(0 if np.isnan(r.value) else r.value)
        return tuple(map(np.array, (kind, i, j, free, value)))

    def start(self, s: np.ndarray) -> np.ndarray:
        """Half the variances, roots of them for loadings of standardized factors, signs by the first indicator."""
        out = np.zeros(self.count)
        at = {x: i for i, x in enumerate(self.observed)}
        fixed_var = {r.lhs for r in self.rows if r.op == "~~" and r.lhs == r.rhs and not r.free}
        for r in self.rows:
            if not r.free:
                continue
            if not np.isnan(r.value):
                x = r.value
            elif r.op == "~~" and r.lhs == r.rhs:
                x = 0.5 * s[at[r.lhs], at[r.lhs]] if r.lhs in at else 0.4 * np.abs(np.diag(s)).mean()
            elif r.op == "=~":
                lead = next(q.rhs for q in self.rows if q.op == "=~" and q.lhs == r.lhs)
                sign = np.sign(s[at[lead], at[r.rhs]]) if lead in at and r.rhs in at else 1.0
                x = (sign or 1.0) * (np.sqrt(0.5 * abs(s[at[r.rhs], at[r.rhs]])) if r.lhs in fixed_var and r.rhs in at else 0.8)
            else:
                x = 0.0
            out[r.free - 1] = min(max(x, r.lower + 1e-6), r.upper - 1e-6)
        return out

    def measurement_fixed(self, cov: CovStruct) -> Model:
        """Paths without the variant take the values of the fit without it; variances stay free."""
        text = "\n".join(f"{r.lhs} {r.op} {('' if r.free else f'{r.value}*')}{r.rhs}" for r in self.rows if "SNP" not in (r.lhs, r.rhs) and "Gene" not in (r.lhs, r.rhs))
        keep = [n for n in cov.names if n in self.observed]
        part = Model.parse(text, keep)
        got = fit(part, cov.subset(keep))
        known = {(r.lhs, r.op, r.rhs): v for r, v in zip(part.rows, got["values"], strict=True)}
        rows, n = [], 0
        for r in self.rows:
            key = (r.lhs, r.op, r.rhs)
            if key in known and r.lhs != r.rhs:
                rows.append(replace(r, free=0, value=float(known[key])))
            else:
                n += bool(r.free)
                rows.append(replace(r, free=n if r.free else 0, value=float(known.get(key, r.value)) if r.free else r.value))
        return Model(self.observed, self.latent, rows, [])


def moments(c: tuple[np.ndarray, ...], p: np.ndarray, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Implied covariances (n, k, k) and their derivatives (n, vech, parameters) at parameters (n, q)."""
    kind, i, j, free, value = c
    n, q = p.shape
    x = np.where(free[None] > 0, p[:, np.maximum(free - 1, 0)] if q else 0, value[None])
    b = np.zeros((n, total, total))
    psi = np.zeros((n, total, total))
    path, var = ~kind, kind
    b[:, i[path], j[path]] = x[:, path]
    psi[:, i[var], j[var]] = x[:, var]
    psi[:, j[var], i[var]] = x[:, var]
    inv = np.linalg.inv(np.eye(total) - b)
    whole = inv @ psi @ inv.transpose(0, 2, 1)
    top = inv[:, :k]
    rows = np.array(vech_pairs(k))
    delta = np.zeros((n, len(rows), q))
    for t in np.flatnonzero(free > 0):
        if kind[t]:
            d = top[:, :, i[t], None] * top[:, None, :, j[t]]
            d = d if i[t] == j[t] else d + d.transpose(0, 2, 1)
        else:
            d = top[:, :, i[t], None] * whole[:, None, j[t], :k]
            d = d + d.transpose(0, 2, 1)
        delta[:, :, free[t] - 1] += d[:, rows[:, 0], rows[:, 1]]
    return whole[:, :k, :k], delta


def gauss_newton(model: Model, s: np.ndarray, weights: np.ndarray, start: np.ndarray, tol: float = 1e-9, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Diagonally weighted least squares for a batch: parameters, convergence, implied moments, derivatives."""
    k = len(model.observed)
    c = model.compiled()
    total = k + len(model.latent)
    rows = np.array(vech_pairs(k))
    low, high = np.full(model.count, -np.inf), np.full(model.count, np.inf)
    for r in model.rows:
        if r.free:
            low[r.free - 1], high[r.free - 1] = max(low[r.free - 1], r.lower), min(high[r.free - 1], r.upper)
    p = np.broadcast_to(start, (len(s), model.count)).copy()
    seen = s[:, rows[:, 0], rows[:, 1]]
    done = np.zeros(len(s), bool)

    def loss(p, at):
        sigma, delta = moments(c, p, k, total)
        e = seen[at] - sigma[:, rows[:, 0], rows[:, 1]]
        return (weights[at] * e * e).sum(1), e, delta

    for _ in range(steps):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        f, e, delta = loss(p[at], at)
        wd = weights[at][:, :, None] * delta
        h = delta.transpose(0, 2, 1) @ wd
        g = (wd * e[:, :, None]).sum(1)
        ridge = 1e-12 * np.trace(h, axis1=1, axis2=2)[:, None, None] * np.eye(model.count)
        step = np.linalg.solve(h + ridge, g[:, :, None])[:, :, 0]
        t = np.ones(len(at))
        new = np.clip(p[at] + step, low, high)
        for _ in range(24):
            worse = ~(loss(new, at)[0] <= f * (1 + 1e-12) + 1e-300)
            if not worse.any():
                break
            t[worse] /= 2
            new[worse] = np.clip(p[at] + t[:, None] * step, low, high)[worse]
        moved = (np.abs(new - p[at]) / (1 + np.abs(p[at]))).max(1, initial=0)
        p[at] = new
        done[at] = moved < tol
    sigma, delta = moments(c, p, k, total)
    return p, done, sigma, delta


def fit_batch(model: Model, s: np.ndarray, v_snp: np.ndarray, v_ld: np.ndarray, var_se2: np.ndarray) -> dict[str, np.ndarray]:
    """Fit a model of the variant (first) and the traits to many variants: estimates, sandwich SEs, chi-squared by blocks."""
    k = len(model.observed)
    n = len(s)
    pairs = vech_pairs(k)
    diag = np.empty((n, len(pairs)))
    head = k
    diag[:, 0] = var_se2
    diag[:, 1:head] = np.diagonal(v_snp, axis1=1, axis2=2)
    diag[:, head:] = np.diag(v_ld)
    p, done, sigma, delta = gauss_newton(model, s, 1 / diag, model.start(s.mean(0)))
    wd = delta / diag[:, :, None]
    bread = np.linalg.pinv(delta.transpose(0, 2, 1) @ wd)
    ld = wd[:, head:].transpose(0, 2, 1) @ v_ld @ wd[:, head:]
    meat = ld + wd[:, 1:head].transpose(0, 2, 1) @ v_snp @ wd[:, 1:head] + wd[:, :1].transpose(0, 2, 1) * var_se2[:, None, None] @ wd[:, :1]
    se = np.sqrt(np.maximum(np.diagonal(bread @ meat @ bread, axis1=1, axis2=2), 0))
    residual = s - sigma
    rows = np.array(pairs)
    e = residual[:, rows[:, 0], rows[:, 1]]
    chi = e[:, 0] ** 2 / var_se2 + np.einsum("ni,ni->n", e[:, 1:head], np.linalg.solve(v_snp, e[:, 1:head, None])[:, :, 0])
    chi += np.einsum("ni,ij,nj->n", e[:, head:], np.linalg.pinv(v_ld), e[:, head:])
    return {"est": p, "se": se, "chisq": chi, "converged": done, "residual": residual}


def smoothed(cov: CovStruct) -> CovStruct:
    s = cov.s if np.linalg.eigvalsh(cov.s).min() > 0 else nearest_positive(cov.s)
    v = cov.v if np.linalg.eigvalsh(cov.v).min() > 0 else nearest_positive(cov.v)
    return replace(cov, s=s, v=v)


def ml_fit(model: Model, s: np.ndarray, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Maximum likelihood by Fisher scoring: least squares with the weights of the implied matrix, renewed each step."""
    k = len(model.observed)
    c, total = model.compiled(), k + len(model.latent)
    p = start[None].copy()
    loss = lambda m: np.linalg.slogdet(m)[1] + np.trace(s @ np.linalg.inv(m)) if np.linalg.eigvalsh(m).min() > 0 else np.inf
    for _ in range(steps):
        sigma, delta = moments(c, p, k, total)
        inv = np.linalg.inv(sigma[0])
        full = np.array([unvech(delta[0, :, j], k) for j in range(model.count)])
        a = np.array([inv @ d for d in full])
        h = np.einsum("aij,bji->ab", a, a)
        g = np.array([np.trace(x @ inv @ (s - sigma[0])) for x in a])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        t, f = 1.0, loss(sigma[0])
        while t > 1e-6 and not loss(moments(c, p + t * step, k, total)[0][0]) <= f + 1e-12:
            t /= 2
        p = p + t * step
        if np.abs(t * step).max(initial=0) < 1e-10:
            break
    return p[0]


def fit(model: Model, cov: CovStruct, estimation: str = "DWLS", smooth: bool = True) -> dict:
    """Estimates, sandwich covariance, residuals, chi-squared, CFI, SRMR and AIC of one model."""
    cov = cov.subset([x for x in cov.names if x in model.observed])
    cov = smoothed(cov) if smooth else cov
    k = len(model.observed)
    w = 1 / np.diag(cov.v)
    start = model.start(cov.s)
    if estimation == "ML":
        p = ml_fit(model, cov.s, start)[None]
        sigma, delta = moments(model.compiled(), p, k, k + len(model.latent))
        done = np.array([True])
    else:
        p, done, sigma, delta = gauss_newton(model, cov.s[None], w[None], start)
        if not done[0]:
            rows = [replace(r, lower=max(r.lower, 1e-4)) if r.op == "~~" and r.lhs == r.rhs else r for r in model.rows]
            model = replace(model, rows=rows)
            p, done, sigma, delta = gauss_newton(model, cov.s[None], w[None], np.abs(start))
    d = delta[0]
    if estimation == "ML":
        inv = np.linalg.inv(sigma[0])
        pairs = vech_pairs(k)
        gamma = np.array([[0.5 * (inv[a, c] * inv[b, e] + inv[a, e] * inv[b, c]) * (1 if a == b else 2) * (1 if c == e else 2) / (1 if a == b and c == e else 1) for c, e in pairs] for a, b in pairs])
        wd = gamma @ d
    else:
        wd = w[:, None] * d
    bread = np.linalg.pinv(d.T @ wd)
    acov = bread @ (wd.T @ cov.v @ wd) @ bread
    e = vech(cov.s - sigma[0])
    inv_v = np.linalg.pinv(cov.v)
    chi, df = float(e @ inv_v @ e), len(e) - model.count
    null = vech(cov.s - np.diag(np.diag(cov.s)))
    chi0, df0 = float(null @ inv_v @ null), k * (k - 1) // 2
    sd = np.sqrt(np.abs(np.diag(cov.s)))
    values = np.array([p[0, r.free - 1] if r.free else r.value for r in model.rows])
    ses = np.array([np.sqrt(max(acov[r.free - 1, r.free - 1], 0)) if r.free else np.nan for r in model.rows])
    best = max(chi - df, 0.0)
    worst = max(chi0 - df0, best, 1e-300)
    return {
        "model": model, "cov": cov, "p": p[0], "acov": acov, "values": values, "ses": ses, "sigma": sigma[0], "residual": cov.s - sigma[0], "converged": bool(done[0]),
        "chisq": chi if df else np.nan, "df": df, "p_chisq": chi2_tail(chi, df) if df else np.nan, "aic": chi + 2 * model.count if df else np.nan, "cfi": 1 - best / worst if df else np.nan, "srmr": float(np.sqrt(np.mean((vech(cov.s - sigma[0]) / vech(np.outer(sd, sd))) ** 2))),
    }


def table(got: dict) -> list[dict]:
    """A row per parameter, with standardized estimates, then the defined ones by the delta method."""
    model = got["model"]
    k = len(model.observed)
    total = k + len(model.latent)
    at = {x: i for i, x in enumerate([*model.observed, *model.latent])}

    def spread(p):
        kind, i, j, free, value = model.compiled()
        x = np.where(free > 0, p[np.maximum(free - 1, 0)], value)
        b, psi = np.zeros((total, total)), np.zeros((total, total))
        b[i[~kind], j[~kind]] = x[~kind]
        psi[i[kind], j[kind]] = psi[j[kind], i[kind]] = x[kind]
        inv = np.linalg.inv(np.eye(total) - b)
        return np.sqrt(np.abs(np.diag(inv @ psi @ inv.T))), x

    sd, x = spread(got["p"])
    out = []
    for r, v, se in zip(model.rows, x, got["ses"], strict=True):
        a, b = sd[at[r.lhs]], sd[at[r.rhs]]
        scale = b / a if r.op == "~" else (a / b if r.op == "=~" else 1 / (a * b))
        z = v / se if se == se and se > 0 else np.nan
        out.append({"lhs": r.lhs, "op": r.op, "rhs": r.rhs, "est": float(v), "se": float(se), "std_all": float(v * scale), "std_se": float(se * scale), "p_value": two_sided(z) if z == z else np.nan})
    names = {r.label: r.free - 1 for r in model.rows if r.label and r.free}
    for name, text in model.defined:
        def value(p, text=text):
            return float(arithmetic(text, {n: p[j] for n, j in names.items()}))

        e = 1e-6 * (1 + np.abs(got["p"]))
        grad = np.array([(value(got["p"] + e[j] * np.eye(len(e))[j]) - value(got["p"] - e[j] * np.eye(len(e))[j])) / (2 * e[j]) for j in range(len(e))])
        v, se = value(got["p"]), float(np.sqrt(max(grad @ got["acov"] @ grad, 0)))
        out.append({"lhs": name, "op": ":=", "rhs": text, "est": v, "se": se, "std_all": np.nan, "std_se": np.nan, "p_value": two_sided(v / se) if se else np.nan})
    return out


OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
FUNCTIONS = {"sqrt": np.sqrt, "exp": np.exp, "log": np.log, "abs": abs}


def arithmetic(text: str, names: dict[str, float]) -> float:
    """Value of a defined parameter: numbers, labels, + - * / ^ and four functions; anything else is refused."""

    def value(x: ast.AST) -> float:
        match x:
            case ast.Constant(value=int() | float()):
                return x.value
            case ast.Name() if x.id in names:
                return names[x.id]
            case ast.BinOp() if type(x.op) in OPERATORS:
                return OPERATORS[type(x.op)](value(x.left), value(x.right))
            case ast.UnaryOp() if type(x.op) in OPERATORS:
                return OPERATORS[type(x.op)](value(x.operand))
            case ast.Call(func=ast.Name(id=f), args=[one], keywords=[]) if f in FUNCTIONS:
                return FUNCTIONS[f](value(one))
        raise ValueError(f"not arithmetic on labels: {text}")

    return value(ast.parse(text.replace("^", "**").strip(), mode="eval").body)


def usermodel(cov: CovStruct, model: str, estimation: str = "DWLS", std_lv: bool = False) -> dict:
    keep = [x for x in cov.names if re.search(rf"\b{re.escape(x)}\b", model)]
    got = fit(Model.parse(model, keep, std_lv), cov.subset(keep), estimation)
    return {"fit": {k: got[k] for k in ("chisq", "df", "p_chisq", "aic", "cfi", "srmr", "converged")}, "results": table(got), "raw": got}


def common_factor(cov: CovStruct, estimation: str = "DWLS") -> dict:
    """One factor with unit variance and free loadings."""
    if len(cov.names) < 3:
        raise ValueError("a common factor needs three traits")
    return usermodel(cov, f"F1 =~ {' + '.join('NA*' + x for x in cov.names)}\nF1 ~~ 1*F1", estimation)


def rg_model(cov: CovStruct) -> tuple[np.ndarray, np.ndarray]:
    """Genetic correlations and their covariance by the delta method (the saturated model's result)."""
    k = len(cov.s)
    d = np.sqrt(np.diag(cov.s))
    r = cov.s / np.outer(d, d)
    pairs = vech_pairs(k)
    number = {p: n for n, p in enumerate(pairs)}
    jac = np.zeros((len(pairs), len(pairs)))
    for n, (i, j) in enumerate(pairs):
        if i != j:
            jac[n, n] = 1 / (d[i] * d[j])
            jac[n, number[i, i]] = -0.5 * r[i, j] / cov.s[i, i]
            jac[n, number[j, j]] = -0.5 * r[i, j] / cov.s[j, j]
    return r, jac @ cov.v @ jac.T


def enrich(baseline: CovStruct, annotations: dict[str, CovStruct], model: str, params: list[tuple[str, str, str]], prop: dict[str, float], fix: str = "regressions") -> list[dict]:
    """Enrichment of parameters by annotation: the share of the baseline's estimate over the annotation's share of variants.

    The baseline's paths (or covariances, or variances) are fixed; the rest is fitted again to each annotation.
    """
    base = usermodel(baseline, model)
    known = {(r["lhs"], r["op"], r["rhs"]): r["est"] for r in base["results"]}
    spec = base["raw"]["model"]
    held = lambda r: r.op in ("=~", "~") if fix == "regressions" else (r.op == "~~" and (r.lhs == r.rhs) == (fix == "variances"))
    rows, n = [], 0
    for r in spec.rows:
        if not r.free or held(r):
            rows.append(replace(r, free=0, value=known[r.lhs, r.op, r.rhs]))
        else:
            n += 1
            rows.append(replace(r, free=n))
    spec = replace(spec, rows=rows)
    out = []
    for name, cov in annotations.items():
        got = {(r["lhs"], r["op"], r["rhs"]): r for r in table(fit(spec, cov))}
        for p in params:
            e = got[p]["est"] / known[p] / prop[name]
            se = got[p]["se"] / abs(known[p]) / prop[name]
            out.append({"annotation": name, "lhs": p[0], "op": p[1], "rhs": p[2], "enrichment": e, "enrichment_se": se, "p_value": two_sided((e - 1) / se) / 2 if e > 1 else 1 - two_sided((e - 1) / se) / 2})
    return out


def q_trait(cov: CovStruct, factors: dict[str, list[str]], external: list[str], steps: int = 5) -> list[dict]:
    """Heterogeneity of each external trait's relation to the factors: the common pathway against free direct paths.

    The most extreme residuals are freed one by one until the traits' parts of them are small.
    """
    out = []
    measure = "\n".join(f"{f} =~ {' + '.join('NA*' + x for x in ts)}\n{f} ~~ 1*{f}" for f, ts in factors.items())
    base = usermodel(cov.subset([x for ts in factors.values() for x in ts]), measure)
    frozen = "\n".join(f"{r['lhs']} =~ {r['est']}*{r['rhs']}" for r in base["results"] if r["op"] == "=~") + "\n" + "\n".join(f"{f} ~~ 1*{f}" for f in factors)
    inside = [x for ts in factors.values() for x in ts]
    for e in external:
        keep = [*inside, e]
        common = usermodel(cov.subset(keep), f"{frozen}\n{' + '.join(factors)} ~~ {e}")
        res = common["raw"]["residual"]
        names = common["raw"]["model"].observed
        at = names.index(e)
        sd = np.sqrt(np.abs(np.diag(common["raw"]["cov"].s)))
        gap = np.array([res[names.index(x), at] / (sd[names.index(x)] * sd[at]) for x in inside])
        free = usermodel(cov.subset(keep), frozen + "\n" + "\n".join(f"{x} ~~ {e}" for x in inside))
        q, df = common["fit"]["chisq"] - free["fit"]["chisq"], free["raw"]["model"].count - common["raw"]["model"].count
        freed: list[str] = []
        for _ in range(min(steps, len(inside) - 1)):
            worst = inside[int(np.abs(gap).argmax())]
            if np.abs(gap).max() < 0.1:
                break
            freed.append(worst)
            again = usermodel(cov.subset(keep), f"{frozen}\n{' + '.join(factors)} ~~ {e}\n" + "\n".join(f"{x} ~~ {e}" for x in freed))
            r2 = again["raw"]["residual"]
            gap = np.array([0.0 if x in freed else r2[names.index(x), at] / (sd[names.index(x)] * sd[at]) for x in inside])
        rg = [r["est"] for r in common["results"] if r["op"] == "~~" and e in (r["lhs"], r["rhs"]) and (r["lhs"] in factors or r["rhs"] in factors)]
        lsrmr = float(np.sqrt(np.mean(np.array([res[names.index(x), at] / (sd[names.index(x)] * sd[at]) for x in inside]) ** 2)))
        p = chi2_tail(max(q, 0), max(df, 1))
        out.append({"trait": e, "q": float(q), "q_df": int(df), "q_pval": p, "lsrmr": lsrmr, "rms_rg": float(np.sqrt(np.mean(np.square(rg)))), "heterogeneous": bool(p < 0.05 / len(external) and lsrmr > 0.1), "freed": ",".join(freed)})
    return out


def summary_gls(y: np.ndarray, v: np.ndarray, predictors: np.ndarray, intercept: bool = True) -> list[dict]:
    """Generalized least squares of parameters on predictors."""
    x = np.asarray(predictors, float).reshape(len(y), -1)
    x = np.column_stack([np.ones(len(y)), x]) if intercept else x
    w = np.linalg.solve(v, x)
    bread = np.linalg.inv(x.T @ w)
    beta = bread @ (w.T @ y)
    se = np.sqrt(np.diag(bread))
    return [{"term": f"b{j + (not intercept)}", "beta": float(b), "se": float(s), "z": float(b / s), "p": two_sided(b / s)} for j, (b, s) in enumerate(zip(beta, se, strict=True))]


def gls_bands(y: np.ndarray, v: np.ndarray, predictor: np.ndarray, controls: np.ndarray | None = None, quadratic: bool = False, points: int = 20) -> list[dict]:
    """Fitted line and SE at points of the predictor: the intercept's SE with the predictor shifted there."""
    out = []
    for at in np.linspace(predictor.min(), predictor.max(), points):
        x = predictor - at
        cols = [x] + ([x**2] if quadratic else []) + ([controls] if controls is not None else [])
        b0 = summary_gls(y, v, np.column_stack(cols))[0]
        out.append({"x": float(at), "fit": b0["beta"], "se": b0["se"]})
    return out


def write_model(loadings: np.ndarray, traits: list[str], cutoff: float, fix_resid: bool = True, bifactor: bool = False, must_load: bool = False, common: bool = False) -> str:
    """Model text of the loadings over a cutoff; with ``must_load`` every trait loads on its strongest factor at least."""
    lines = []
    for f in range(loadings.shape[1]):
        own = [t for j, t in enumerate(traits) if abs(loadings[j, f]) >= cutoff or (must_load and int(np.abs(loadings[j]).argmax()) == f)]
        if own:
            lines.append(f"F{f + 1} =~ " + " + ".join("NA*" + t if k == 0 else t for k, t in enumerate(own)) + f"\nF{f + 1} ~~ 1*F{f + 1}")
    n = len(lines)
    if common or bifactor:
        lines.append("Common =~ " + " + ".join("NA*" + t if k == 0 else t for k, t in enumerate(traits)) + "\nCommon ~~ 1*Common")
    if bifactor:
        names = [f"F{f + 1}" for f in range(n)] + ["Common"]
        lines += [f"{a} ~~ 0*{b}" for k, a in enumerate(names) for b in names[k + 1 :]]
    if fix_resid:
        lines += [f"{t} ~~ r{j}*{t}\nr{j} > .0001" for j, t in enumerate(traits)]
    return "\n".join(lines)


def index_s(names: list[str]) -> list[dict]:
    """Place in vech order of each pair of traits."""
    return [{"place": n + 1, "row": names[i], "col": names[j]} for n, (i, j) in enumerate(vech_pairs(len(names)))]


def multi_snp(cov: CovStruct, beta: np.ndarray, se: np.ndarray, maf: np.ndarray, ld: np.ndarray, var_se: float = 5e-4, variances: np.ndarray | None = None) -> CovStruct:
    """Joint S and V of several variants (or genes, with ``variances``) and the traits, by index instead of scans.

    Covariances of variants are LD times their standard deviations; those with a trait are variance times effect. The
    sampling covariance between (variant f, trait x) and (g, y) is SE times SE times intercept times LD, in the variants' scale.
    """
    f, k = beta.shape
    var = 2 * maf * (1 - maf) if variances is None else variances
    sd = np.sqrt(var)
    n = f + k
    s = np.zeros((n, n))
    s[:f, :f] = ld * np.outer(sd, sd)
    s[f:, :f] = (var[:, None] * beta).T
    s[:f, f:] = s[f:, :f].T
    s[f:, f:] = cov.s
    g = np.maximum(np.diag(cov.i), 1)
    inter = cov.i.copy()
    np.fill_diagonal(inter, 1)
    pairs = vech_pairs(n)
    v = np.zeros((len(pairs), len(pairs)))
    order = {p: m for m, p in enumerate(vech_pairs(k))}
    for a, (i, j) in enumerate(pairs):
        for b, (r, c) in enumerate(pairs):
            if j < f and c < f and i < f and r < f:
                v[a, b] = var_se**2 if a == b else 0
            elif j < f <= i and c < f <= r:
                x, y = i - f, r - f
                link = 1 if j == c else ld[j, c]
                v[a, b] = se[j, x] * g[x] * se[c, y] * g[y] * inter[x, y] * link * var[j] ** (1 if j == c else 0.5) * var[c] ** (1 if j == c else 0.5)
            elif j >= f and c >= f:
                v[a, b] = cov.v[order[i - f, j - f], order[r - f, c - f]]
    return CovStruct(s, v, cov.i, [f"SNP{j + 1}" for j in range(f)] + cov.names, None, cov.m)
