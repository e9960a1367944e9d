"""Feature transforms: log1p, Box-Cox / Yeo-Johnson (MLE lambda), polynomial terms, PCA,
mutual information, problem-type inference."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import distinct_up_to
from ..functions.exprs import number
from ..functions.gram import moments
from ..functions.roles import NUMERIC, present, role_of
from ..plans.stage import Stage, register


def _numeric(df, cols):
    return [c for c in present(df, cols) if role_of(df.schema[c].dataType) == NUMERIC]


# ------------------------------------------------------------------ log1p

def fit_log1p(df: DataFrame, cols: list[str]) -> Stage:
    """shift = |min| + 1 when min <= 0, else 0; x -> ln(1 + x + shift)."""
    cols = _numeric(df, cols)
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0] if cols else {}
    shifts = {}
    for i, c in enumerate(cols):
        m = r[f"m{i}"]
        shifts[c] = abs(m) + 1.0 if (m is not None and m <= 0) else 0.0
    return Stage("math", {"method": "log1p", "shift": shifts})


# --------------------------------------------------------- power transforms

def box_cox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / lam


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    neg = (-F.log1p(-x)) if abs(lam - 2.0) < 1e-12 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _power_expr(method, x, lam):
    return box_cox_expr(x, lam) if method == "box-cox" else yeo_johnson_expr(x, lam)


def _loglik_terms(method: str, x: Column, lams: list[float]):
    """Aggregates whose values give the profile log-likelihood at each lambda."""
    aggs = [F.count(x).alias("n")]
    if method == "box-cox":
        aggs.append(F.sum(F.log(x)).alias("jac"))
    else:
        aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jac"))
    for j, lam in enumerate(lams):
        y = _power_expr(method, x, lam)
        aggs += [F.var_pop(y).alias(f"v{j}")]
    return aggs


#: Grid points of a round, rounds, and the width at which the search for lambda ends.
LAMBDA_POINTS, LAMBDA_ROUNDS, LAMBDA_WIDTH = 21, 40, 1e-8


def _log_likelihood(method: str, lam: float, n: int, jac: float, var: float | None) -> float:
    if var is None or var <= 0 or math.isnan(var) or math.isinf(var):
        return -math.inf
    if method == "box-cox":  # of values divided by their geometric mean, whose logarithms add up to nothing
        return -n / 2.0 * math.log(var)
    return -n / 2.0 * math.log(var) + (lam - 1.0) * jac


def fit_lambdas(df: DataFrame, cols: list[str], method: str, shifts: dict[str, float], lo: float = -5.0, hi: float = 5.0) -> dict[str, float]:
    """Maximum-likelihood lambda of every column: a round evaluates the grids of all columns in one
    aggregate. A bracket whose best point is at an end moves on that way and doubles; otherwise it closes
    in around the best point. Missing values are left out; a column without two values gets 1."""
    x = {c: number(c) + F.lit(float(shifts.get(c, 0.0))) for c in cols}
    if method == "box-cox":
        logs = df.agg(*[F.avg(F.when(x[c] > 0, F.log(x[c]))).alias(f"g{i}") for i, c in enumerate(cols)]).first()
        x = {c: x[c] / F.lit(math.exp(logs[f"g{i}"] or 0.0)) for i, c in enumerate(cols)}
    bracket, best = {c: (lo, hi) for c in cols}, {c: 1.0 for c in cols}
    for _ in range(LAMBDA_ROUNDS):
        open_cols = [c for c in cols if c in bracket]
        if not open_cols:
            break
        grids = {c: [float(v) for v in np.linspace(*bracket[c], LAMBDA_POINTS)] for c in open_cols}
        aggs = []
        for i, c in enumerate(open_cols):
            terms = _loglik_terms(method, x[c], grids[c])
            aggs += [F.struct(*terms).alias(f"t{i}")]
        r = df.agg(*aggs).first()
        for i, c in enumerate(open_cols):
            t, grid = r[f"t{i}"], grids[c]
            scores = [_log_likelihood(method, lam, t["n"], t["jac"] or 0.0, t[f"v{j}"]) for j, lam in enumerate(grid)]
            top = max(scores)
            if top == -math.inf:
                del bracket[c]
                continue
            k = scores.index(top)
            best[c] = grid[k]
            a, b = bracket[c]
            step = (b - a) / (LAMBDA_POINTS - 1)
            if k == 0:
                bracket[c] = (a - 2 * (b - a), a + step)
            elif k == LAMBDA_POINTS - 1:
                bracket[c] = (b - step, b + 2 * (b - a))
            elif step < LAMBDA_WIDTH or max(abs(scores[k - 1] - top), abs(scores[k + 1] - top)) <= 1e-14 * abs(top):
                del bracket[c]
            else:
                bracket[c] = (grid[k - 1], grid[k + 1])
    return best


def fit_power(df: DataFrame, cols: list[str], method: str = "yeo-johnson", lambdas: dict | None = None,
              standardize: bool = True) -> Stage:
    """Box-Cox (after the log1p-style shift when min <= 0) or Yeo-Johnson, then standardised
    with the transformed column's mean and population std."""
    cols = _numeric(df, cols)
    method = method.lower()
    shifts = {c: 0.0 for c in cols}
    if method == "box-cox" and cols:
        r = df.agg(*[F.min(number(c)).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
        for i, c in enumerate(cols):
            m = r[f"m{i}"]
            shifts[c] = abs(m) + 1.0 if (m is not None and m <= 0) else 0.0
    lam = dict(lambdas or {})
    lam.update(fit_lambdas(df, [c for c in cols if c not in lam], method, shifts) if any(c not in lam for c in cols) else {})
    center, scale = {}, {}
    if standardize and cols:
        ys = {c: _power_expr(method, number(c) + F.lit(shifts[c]), lam[c]) for c in cols}
        r = df.agg(*[F.avg(ys[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(ys[c]).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
        for i, c in enumerate(cols):
            center[c] = r[f"a{i}"] or 0.0
            s = r[f"s{i}"]
            scale[c] = s if s not in (None, 0.0) else 1.0
    return Stage("math", {"method": method, "shift": shifts, "lambda": lam, "center": center, "scale": scale})


@register("math")
def _apply_math(df, p):
    method = p["method"]
    sh = p["shift"]
    out = []
    for c in df.columns:
        if c not in sh:
            out.append(F.col(c))
            continue
        x = F.col(c).cast("double") + F.lit(float(sh[c]))
        if method == "log1p":
            out.append(F.log1p(x).alias(c))
            continue
        y = _power_expr(method, x, p["lambda"][c])
        if p.get("center"):
            y = (y - F.lit(p["center"][c])) / F.lit(p["scale"][c])
        out.append(y.alias(c))
    return df.select(*out)


# ------------------------------------------------------------- polynomial

def poly_terms(cols: list[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = False):
    """(name, [columns multiplied]) in the conventional order: by degree, then index order;
    names ``a``, ``a^2``, ``a b``, bias ``1``."""
    terms = []
    if include_bias:
        terms.append(("1", []))
    for d in range(1, degree + 1):
        combos = itertools.combinations(range(len(cols)), d) if interaction_only else \
            itertools.combinations_with_replacement(range(len(cols)), d)
        for combo in combos:
            counts = {}
            for i in combo:
                counts[i] = counts.get(i, 0) + 1
            name = " ".join(cols[i] if k == 1 else f"{cols[i]}^{k}" for i, k in sorted(counts.items()))
            terms.append((name, [cols[i] for i in combo]))
    return terms


def fit_poly(df: DataFrame, cols: list[str], degree: int = 2, interaction_only: bool = False,
             include_bias: bool = False) -> Stage:
    cols = _numeric(df, cols)
    if len(cols) > 15 and degree > 2:
        raise ValueError("a degree above 2 takes no more columns than the limit")
    return Stage("poly", {"columns": cols, "degree": degree, "interaction_only": interaction_only,
                          "include_bias": include_bias})


@register("poly")
def _apply_poly(df, p):
    cols = p["columns"]
    if not all(c in df.columns for c in cols):
        raise ValueError("polynomial stage: input columns missing")
    keep = [F.col(c) for c in df.columns if c not in cols]
    new = []
    for name, factors in poly_terms(cols, p["degree"], p["interaction_only"], p["include_bias"]):
        e = F.lit(1.0)
        for f in factors:
            e = e * F.col(f).cast("double")
        new.append(e.alias(name))
    return df.select(*keep, *new)


# -------------------------------------------------------------------- PCA

def fit_pca(df: DataFrame, cols: list[str], n_components: int | float = 0.95, standardize: bool = True) -> Stage:
    """Covariance of the (optionally standardised) columns over rows without a missing value, from one
    pass that folds each task's rows into matrices; eigen-decomposition of the small d x d matrix on the driver. Signs fixed so
    each component's largest-magnitude loading is positive. A float ``n_components`` keeps the
    smallest k whose cumulative explained variance reaches it."""
    cols = _numeric(df, cols)
    if not cols:
        raise ValueError("PCA needs at least one numeric column")
    d = len(cols)
    m = moments(df, cols, complete=True)
    n = m.n[0, 0]
    mean, std = m.mean[:, 0].copy(), np.sqrt(np.diag(m.product) / max(n, 1))
    std[std == 0] = 1.0
    cov = m.product / max(n - 1, 1)
    if standardize:
        cov = cov / np.outer(std, std)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    for k in range(d):
        if v[np.argmax(np.abs(v[:, k])), k] < 0:
            v[:, k] = -v[:, k]
    ratio = w / w.sum() if w.sum() > 0 else np.zeros_like(w)
    if isinstance(n_components, float) and n_components < 1:
        k = int(np.searchsorted(np.cumsum(ratio), n_components, side="right") + 1)
        k = min(k, d)
    else:
        k = min(int(n_components), d)
    return Stage("pca", {"columns": cols, "mean": mean.tolist(), "std": (std if standardize else np.ones(d)).tolist(),
                         "components": v[:, :k].T.tolist(), "explained_variance": w[:k].tolist(),
                         "explained_variance_ratio": ratio[:k].tolist()})


@register("pca")
def _apply_pca(df, p):
    cols = p["columns"]
    if not all(c in df.columns for c in cols):
        raise ValueError("PCA stage: input columns missing")
    z = [(F.col(c).cast("double") - F.lit(p["mean"][i])) / F.lit(p["std"][i]) for i, c in enumerate(cols)]
    pcs = []
    for k, comp in enumerate(p["components"]):
        e = F.lit(0.0)
        for i, wgt in enumerate(comp):
            e = e + z[i] * F.lit(float(wgt))
        pcs.append(e.alias(f"PC_{k + 1}"))
    return df.select(*[F.col(c) for c in df.columns if c not in cols], *pcs)


def explained_variance(stage: Stage, spark) -> DataFrame:
    r = stage.params["explained_variance_ratio"]
    rows = [(f"PC_{i + 1}", float(v), float(sum(r[: i + 1]))) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "component string, ratio double, cumulative double")


# ------------------------------------------------------- problem type / MI

def infer_problem_type(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """Numeric with more than ``max_classes`` distinct values -> Regression, else Classification."""
    if role_of(df.schema[target].dataType) != NUMERIC:
        return "Classification"
    return "Regression" if distinct_up_to(df, [target], max_classes)[target] > max_classes else "Classification"


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """I(X;Y) in nats per feature; numeric features in ``bins`` equal-width bins, text as is.
    Rows with a missing feature or target are left out. One contingency group-by."""
    num = set(_numeric(df, features))
    rng = {}
    if num:
        r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in num],
                   *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in num]).collect()[0]
        rng = {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in num}

    def key(c):
        if c in num:
            lo, hi = rng[c]
            if lo is None or hi is None or hi == lo:
                return F.when(F.col(c).isNotNull(), F.lit("0"))
            b = F.least(F.lit(bins - 1), F.floor((F.col(c).cast("double") - lo) / (hi - lo) * bins).cast("int"))
            return b.cast("string")
        return F.col(c).cast("string")

    items = [F.struct(F.lit(c).alias("feature"), key(c).alias("x")) for c in features]
    long = (df.select(F.col(target).cast("string").alias("y"), F.explode(F.array(*items)).alias("kv"))
            .select("kv.feature", "kv.x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    joint = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy"))
    # marginals as grouped sums joined back (no window holding a whole feature in one task);
    # the per-feature totals are one row per feature, broadcast
    nx = joint.groupBy("feature", "x").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("feature", "y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    t = joint.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(F.broadcast(n), "feature")
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny")))
    return t.groupBy("feature").agg(F.sum(term).alias("mutual_info"))
