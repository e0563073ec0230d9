"""Survival analysis: Kaplan-Meier curves, the log-rank test, Weibull AFT
(Spark ML) and the Cox model with Breslow ties.

The time-ordered work runs on tables grouped to one row per distinct (group,
time), and its running sums (subjects at risk, cumulative log survival,
risk-set sums) use the distributed running-sum recipe of ``ranking``, so even
continuous durations with as many distinct times as subjects never meet in
one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns
from tessera.operators.ranking import sorted_cumulative
from tessera.session import scratch_dir


def km_curve(df: DataFrame, duration: str, event: str, by=()) -> DataFrame:
    """One row per (group, distinct time): at risk, events, censored, and the
    product-limit survival (0 from the first time all at risk fail)."""
    by = as_list(by)
    require_columns(df, duration, event, *by)
    g = df.where(F.col(duration).isNotNull()).groupBy(*by, duration).agg(
        F.sum(F.col(event).cast("long")).alias("n_event"), F.count(F.lit(1)).alias("__rows"))
    # at risk at t = subjects with duration >= t = group total - those before t
    c = sorted_cumulative(g, duration, ["__rows"], by)
    c = c.withColumn("n_risk", F.col("__rows_total") - F.col("__rows_before"))
    c = c.select(*by, duration, "n_event", "__rows", "n_risk",
                 F.when(F.col("n_event") < F.col("n_risk"), F.log(1 - F.col("n_event") / F.col("n_risk")))
                 .otherwise(0.0).alias("__term"),
                 F.when(F.col("n_event") == F.col("n_risk"), 1).otherwise(0).alias("__dead"))
    # product-limit = exp(running sum of log terms), 0 once everyone at risk failed
    c = sorted_cumulative(c, duration, ["__term", "__dead"], by)
    dead = (F.col("__dead_before") + F.col("__dead")) > 0
    surv = F.when(dead, F.lit(0.0)).otherwise(F.exp(F.col("__term_before") + F.col("__term")))
    return c.select(*by, F.col(duration).alias("time"), "n_risk", "n_event",
                    (F.col("__rows") - F.col("n_event")).alias("n_censor"), surv.alias("survival"))


def logrank_test(df: DataFrame, duration: str, event: str, group: str, a, b) -> DataFrame:
    """Two-group log-rank: observed and expected events per group, the variance
    and the chi-square statistic (1 df)."""
    d = df.where(F.col(group).isin(a, b))
    ga = F.col(group) == F.lit(a)
    g = d.groupBy(duration).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(ga).alias("__rows_a"),
        F.sum(F.col(event).cast("long")).alias("__d"),
        F.sum(F.when(ga, F.col(event).cast("long")).otherwise(0)).alias("__da"))
    g = sorted_cumulative(g, duration, ["__rows", "__rows_a"])
    g = g.withColumn("__n", F.col("__rows_total") - F.col("__rows_before")) \
        .withColumn("__na", F.col("__rows_a_total") - F.col("__rows_a_before"))
    n, na, dd = F.col("__n"), F.col("__na"), F.col("__d")
    e = dd * na / n
    v = F.when(n > 1, dd * (na / n) * (1 - na / n) * (n - dd) / (n - 1)).otherwise(0.0)
    s = g.agg(F.sum("__da").alias("observed_a"), F.sum(e).alias("expected_a"),
              F.sum("__d").alias("__dt"), F.sum(v).alias("variance"))
    return s.select("observed_a", "expected_a", (F.col("__dt") - F.col("observed_a")).alias("observed_b"),
                    (F.col("__dt") - F.col("expected_a")).alias("expected_b"), "variance",
                    F.try_divide((F.col("observed_a") - F.col("expected_a")) ** 2, F.col("variance")).alias("chisq"))


def _terms(df: DataFrame, duration: str, event: str, xs):
    """Numeric columns as given, or the terms of a formula ``"~ a + b"`` (categorical terms allowed)."""
    if isinstance(xs, str) and "~" in xs:
        from tessera.operators.models import design
        d, _, names = design(df, f"{duration} {xs if xs.lstrip().startswith('~') else '~' + xs.split('~', 1)[1]}", [duration, event])
        return d, names
    return df, as_list(xs)


def aft_fit(df: DataFrame, duration: str, event: str, xs, shift: float = 0.0) -> DataFrame:
    """Weibull accelerated failure time model (Spark ML AFTSurvivalRegression).
    Zero durations are invalid for the log-time model: pass ``shift`` (e.g. 1)
    to add to every duration. Rows: term, estimate; plus log(scale)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    df, xs = _terms(df, duration, event, xs)
    d = df.select((F.col(duration).cast("double") + shift).alias("label"),
                  F.col(event).cast("double").alias("censor"), *[F.col(x).cast("double") for x in xs]).dropna()
    feats = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    m = AFTSurvivalRegression(featuresCol="features", labelCol="label", censorCol="censor").fit(feats)
    rows = [("(Intercept)", float(m.intercept))] + [(x, float(c)) for x, c in zip(xs, m.coefficients)]
    rows.append(("log(scale)", float(math.log(m.scale))))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def cox_fit(df: DataFrame, duration: str, event: str, xs, max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """Cox proportional hazards, Breslow ties, by safeguarded Newton-Raphson.

    One Spark job per evaluation: rows are reduced to per-time sums of
    exp(eta), exp(eta) x and exp(eta) x x' (group by time, k + k^2 sums), and
    the reverse-cumulative risk-set sums run over the distinct-time table.
    The k-vector score and k x k information are solved on the driver. A step that lowers the
    partial likelihood is halved. Rows: term, estimate, std_error, z, iterations (evaluations), loglik, and how the fit ended:

    * ``converged``: the likelihood and the step stand still;
    * ``separated``: the likelihood stands still while the step does not, so an estimate runs to infinity (some
      covariate orders the events completely); estimates are the last ones reached;
    * ``singular``: the information has no inverse (a constant or repeated covariate); the least-norm solution, NULL
      errors where nothing is known;
    * ``no_events``: nothing to fit (no event, or no rows); all numbers are NULL;
    * ``not_converged``: ``max_iter`` evaluations did not suffice."""
    df, xs = _terms(df, duration, event, xs)
    k = len(xs)
    d = df.select(F.col(duration).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"),
                  *[F.col(f"`{x}`").cast("double").alias(f"__x{i}") for i, x in enumerate(xs)]).dropna()
    scratch_dir(df.sparkSession)
    d = d.checkpoint(eager=True)  # reused every iteration; cut lineage once
    one = d.agg(F.sum("__e").alias("d"), *[F.avg(f"__x{i}").alias(f"m{i}") for i in range(k)]).first()
    schema = "term string, estimate double, std_error double, z double, iterations int, loglik double, status string"
    if not one["d"]:
        return df.sparkSession.createDataFrame([(x, None, None, None, 0, None, "no_events") for x in xs], schema)
    # centred covariates leave the estimates as they are and keep exp(eta) small
    d = d.select("__t", "__e", *[(F.col(f"__x{i}") - F.lit(float(one[f"m{i}"]))).alias(f"__x{i}") for i in range(k)])

    beta = np.zeros(k)
    loglik, u, info = _cox_at(d, beta, k)
    status, it = "not_converged", 1
    while it < max_iter:
        step, full = _newton_step(info, u)
        if np.max(np.abs(step)) < tol:
            status = "converged" if full else "singular"
            break
        new = beta + step
        got = _cox_at(d, new, k)
        it += 1
        while not got[0] >= loglik - 1e-12 * abs(loglik) and it < max_iter and np.max(np.abs(step)) >= tol:
            step = step / 2
            new = beta + step
            got = _cox_at(d, new, k)
            it += 1
        if not got[0] >= loglik - 1e-12 * abs(loglik):
            break
        gain, beta = got[0] - loglik, new
        loglik, u, info = got
        if gain <= tol * (abs(loglik) + tol):
            step, full = _newton_step(info, u)
            if np.any((np.abs(step) > tol) & (np.abs(step) > math.sqrt(tol) * np.abs(beta))):
                status = "separated"
            else:
                status = "converged" if full else "singular"
                beta = beta + step
            break
    var = np.diag(np.linalg.pinv(info, rcond=1e-12, hermitian=True))
    rows = []
    for x, b, v in zip(xs, beta, var):
        se = float(math.sqrt(v)) if v > 0 else None
        rows.append((x, float(b), se, float(b / se) if se else None, it, float(loglik), status))
    return df.sparkSession.createDataFrame(rows, schema)


def _newton_step(info: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, bool]:
    """The step and whether the information has full rank (scaled to its diagonal)."""
    scale = np.sqrt(np.where(np.diag(info) > 0, np.diag(info), 1.0))
    full = np.linalg.matrix_rank(info / np.outer(scale, scale), tol=1e-10, hermitian=True) == len(u)
    step = np.linalg.solve(info, u) if full else np.linalg.pinv(info, rcond=1e-10, hermitian=True) @ u
    return step, bool(full)


def _cox_at(d: DataFrame, beta: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information at ``beta``; -inf where they are no numbers."""
    eta = sum((F.lit(float(beta[i])) * F.col(f"__x{i}") for i in range(k)), F.lit(0.0))
    r = F.exp(eta)
    aggs = [F.sum(r).alias("s0"), F.sum("__e").alias("d"),
            F.sum(F.when(F.col("__e") == 1, eta).otherwise(0.0)).alias("eta_ev")]
    aggs += [F.sum(r * F.col(f"__x{i}")).alias(f"s1_{i}") for i in range(k)]
    aggs += [F.sum(F.when(F.col("__e") == 1, F.col(f"__x{i}")).otherwise(0.0)).alias(f"xe_{i}") for i in range(k)]
    aggs += [F.sum(r * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"s2_{i}_{j}")
             for i in range(k) for j in range(i, k)]
    per_t = d.groupBy("__t").agg(*aggs)
    # risk-set sums at t (durations >= t) are summed from the latest time on, so that nothing small is a difference of large sums
    sums = ["s0"] + [f"s1_{i}" for i in range(k)] + [f"s2_{i}_{j}" for i in range(k) for j in range(i, k)]
    per_t = sorted_cumulative(per_t.withColumn("__down", -F.col("__t")), "__down", sums)
    cum = [(F.col(s) + F.col(s + "_before")).alias("S" + s[1:]) for s in sums]
    rs = per_t.select("d", "eta_ev", *[f"xe_{i}" for i in range(k)], *cum).where("d > 0")
    tot = [F.sum("eta_ev").alias("eta_ev"), F.sum(F.col("d") * F.log("S0")).alias("dlogS0")]
    tot += [F.sum(F.col(f"xe_{i}") - F.col("d") * F.try_divide(F.col(f"S1_{i}"), F.col("S0"))).alias(f"u_{i}") for i in range(k)]
    for i in range(k):
        for j in range(i, k):
            tot.append(F.sum(F.col("d") * (F.try_divide(F.col(f"S2_{i}_{j}"), F.col("S0"))
                                           - F.try_divide(F.col(f"S1_{i}") * F.col(f"S1_{j}"), F.col("S0") ** 2)))
                       .alias(f"i_{i}_{j}"))
    row = rs.agg(*tot).first()
    numbers = [row[c] for c in row.asDict()]
    if any(x is None or not math.isfinite(x) for x in numbers):
        return -math.inf, np.zeros(k), np.eye(k)
    u = np.array([row[f"u_{i}"] for i in range(k)])
    info = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            info[i, j] = info[j, i] = row[f"i_{i}_{j}"]
    return row["eta_ev"] - row["dlogS0"], u, info
