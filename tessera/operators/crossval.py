"""Cross-validation of linear models without a fit per fold.

The rows are read once for a linear model and once per iteration for a logistic one, for all folds together.
What a fold contributes is a handful of sums; a training set is the sum of the other folds'.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_dir


def _fold_rows(df: DataFrame, y: str, xs: list[str], fold: str) -> DataFrame:
    """``fold, y, x0..``, as numbers; rows with a NULL are left out."""
    return df.select(F.col(f"`{fold}`").cast("int").alias("fold"), F.col(f"`{y}`").cast("double").alias("y"),
                     *[F.col(f"`{x}`").cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna()


def cv_linear(df: DataFrame, y: str, xs: list[str], fold: str) -> DataFrame:
    """Least squares with an intercept: per fold ``fold, n_train, n_test, rmse, coefficients`` (intercept first) of the
    model of the other folds, from one scan.

    A fold gives its count, means and centred cross products, which Spark merges without cancellation. Sets are
    joined by the rule for merging such moments, and a fold's squared error follows from its own moments and the
    coefficients. A training set without rows has a NULL error and no coefficients; redundant columns get the least-norm solution."""
    names = [f"x{i}" for i in range(len(xs))] + ["y"]
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (_fold_rows(df, y, xs, fold).groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                 *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect())  # one row per fold
    sets = {}
    for r in rows:
        cross = np.zeros((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"c{i}_{j}"] * r["n"]
        sets[r["fold"]] = (r["n"], np.array([r[f"m{i}"] for i in range(p)]), cross)
    out = []
    for f, (n_test, mean, cross) in sorted(sets.items()):
        others = [s for g, s in sets.items() if g != f]
        n = sum(s[0] for s in others)
        if not n:
            out.append((f, 0, n_test, None, None))
            continue
        centre = sum(s[0] * s[1] for s in others) / n
        whole = sum(s[2] + s[0] * np.outer(s[1] - centre, s[1] - centre) for s in others)
        b = np.linalg.lstsq(whole[:-1, :-1], whole[:-1, -1], rcond=1e-12)[0]
        a = centre[-1] - b @ centre[:-1]
        v = np.append(-b, 1.0)
        sse = max(0.0, v @ cross @ v) + n_test * (mean[-1] - a - b @ mean[:-1]) ** 2
        out.append((f, n, n_test, float(np.sqrt(sse / n_test)), [float(a), *map(float, b)]))
    return df.sparkSession.createDataFrame(out, "fold int, n_train long, n_test long, rmse double, coefficients array<double>")


def cv_logistic(df: DataFrame, y: str, xs: list[str], fold: str, max_iter: int = 25, tol: float = 1e-8) -> DataFrame:
    """Logistic regression with an intercept: the columns of ``cv_linear``, errors of the predicted probabilities.

    All folds' models take their reweighted steps together: one scan gives each model the score and the
    information over the rows outside its fold. A step that lowers a model's likelihood is halved. A model is done when its step or the
    gain of its likelihood is small (so also where an estimate runs to infinity), at the latest after ``max_iter`` scans."""
    scratch_dir(df.sparkSession)
    raw = _fold_rows(df, y, xs, fold)
    p = len(xs) + 1
    names = [f"z{i}" for i in range(p)]
    scale = raw.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(p - 1) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    if not scale["n"]:
        return df.sparkSession.createDataFrame([], "fold int, n_train long, n_test long, rmse double, coefficients array<double>")
    centre = np.array([scale[f"m{i}"] for i in range(p - 1)])
    spread = np.array([scale[f"s{i}"] or 1.0 for i in range(p - 1)])
    # standardised once, read once per iteration
    rows = raw.select("fold", "y", F.lit(1.0).alias("z0"), *[((F.col(f"x{i}") - F.lit(float(centre[i]))) / F.lit(float(spread[i]))).alias(f"z{i + 1}")
                                                             for i in range(p - 1)]).checkpoint()
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = sorted(sizes)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    e = sum((F.col(f"b{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("b0"))
    mu = 1 / (1 + F.exp(-e))
    soft = F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))  # log(1 + exp(e)) without overflow

    def beside(models, same: bool) -> DataFrame:
        """Each row with the models of its own fold, or of the others; the coefficients are data, so every iteration runs the same code."""
        table = df.sparkSession.createDataFrame([(f, *map(float, b)) for f, b in models.items()], "model int, " + ", ".join(f"b{i} double" for i in range(p)))
        own = F.col("fold") == F.col("model")
        return rows.join(F.broadcast(table), own if same else ~own)  # one row per fold

    def look(models):
        """Log-likelihood, score and information of each fold's model over the other folds, in one scan."""
        each = beside(models, same=False).select("model", "y", *names, e.alias("e"), mu.alias("mu"), soft.alias("soft"))
        got = each.groupBy("model").agg(
            F.sum(F.col("y") * F.col("e") - F.col("soft")).alias("l"), *[F.sum((F.col("y") - F.col("mu")) * F.col(f"z{i}")).alias(f"u{i}") for i in range(p)],
            *[F.sum(F.col("mu") * (1 - F.col("mu")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"i{i}_{j}") for i, j in pairs])
        out = {}
        for r in got.collect():
            info = np.zeros((p, p))
            for i, j in pairs:
                info[i, j] = info[j, i] = r[f"i{i}_{j}"]
            out[r["model"]] = (r["l"], np.array([r[f"u{i}"] for i in range(p)]), info)
        return out

    live = [f for f in folds if len(folds) > 1]
    beta = {f: np.zeros(p) for f in live}
    now = look(beta) if live else {}
    step = {f: np.linalg.lstsq(now[f][2], now[f][1], rcond=1e-12)[0] for f in live}
    for _ in range(max_iter):
        if not live:
            break
        tried = look({f: beta[f] + step[f] for f in live})
        left = []
        for f in live:
            gain = tried[f][0] - now[f][0]
            if gain < -1e-12 * abs(now[f][0]):
                step[f] = step[f] / 2
                if np.max(np.abs(step[f])) > tol:
                    left.append(f)
                continue
            beta[f], now[f] = beta[f] + step[f], tried[f]
            step[f] = np.linalg.lstsq(now[f][2], now[f][1], rcond=1e-12)[0]
            if np.max(np.abs(step[f])) > tol and gain > 1e-9 * (abs(now[f][0]) + 1):
                left.append(f)
        live = left
    errors = {}
    if beta:
        errors = {r["model"]: r["e"] for r in beside(beta, same=True).groupBy("model").agg(F.sum((F.col("y") - mu) ** 2).alias("e")).collect()}
    out = []
    for f in folds:
        if f not in beta:
            out.append((f, 0, sizes[f], None, None))
            continue
        slopes = beta[f][1:] / spread
        out.append((f, sum(sizes.values()) - sizes[f], sizes[f], float(np.sqrt(errors[f] / sizes[f])),
                    [float(beta[f][0] - slopes @ centre), *map(float, slopes)]))
    return df.sparkSession.createDataFrame(out, "fold int, n_train long, n_test long, rmse double, coefficients array<double>")
