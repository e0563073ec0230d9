"""Model fitting on Spark ML, returned as tidy rows.

Fits run as Spark ML jobs over the distributed training frame, written once; only
the fitted parameters (a handful of numbers per feature, or the tree's node
list) come back, turned into a small DataFrame. Differences from the
single-machine tree libraries the inventory names: Spark bins continuous
features (``maxBins``), has no surrogate splits, no cost-complexity pruning and
no out-of-bag error (use ``cross_validate`` folds instead).
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GeneralizedLinearRegression, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.crossval import cv_linear, cv_logistic
from tessera.session import scratch_dir


def formula_encode(df: DataFrame, formula: str, keep=()) -> DataFrame:
    """R-style formula to (label, features): categorical terms one-hot encoded
    (reference level dropped), numeric terms as they are. Features are
    returned as an array column next to the kept columns. Rows with a NULL input are
    left out; levels are in order of frequency, then name, and the last is the reference."""
    rf = RFormula(formula=formula, featuresCol="__f", labelCol="label", handleInvalid="skip")
    m = rf.fit(df)
    out = m.transform(df)
    return out.select(*keep, "label", vector_to_array("__f").alias("features"))


def design(df: DataFrame, formula: str, keep=()) -> tuple[DataFrame, str, list[str]]:
    """The columns of an R-style formula: (frame with the kept columns, the label as ``label`` and one
    numeric column per term, "label", term names). Categorical terms become 0/1 columns, the reference
    level dropped; rows with a NULL input are left out."""
    out = RFormula(formula=formula, featuresCol="__f", labelCol="label", handleInvalid="skip").fit(df).transform(df)
    names = feature_names(out, "__f")
    f = vector_to_array("__f")
    return out.select(*keep, "label", *[f[i].alias(n) for i, n in enumerate(names)]), "label", names


def feature_names(encoded: DataFrame, col: str = "features") -> list[str]:
    """Names of the slots of an ML vector column (from its attribute metadata)."""
    meta = encoded.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for group in meta.values() for a in group)
    return [n for _, n in slots]


def _prepared(df: DataFrame, formula: str):
    """Encode once and write for the fit, which reads it many times; memory is left to others. Rows with NULL inputs are skipped;
    a numeric 0/1 label is used as it is (indexing it would add levels)."""
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label", handleInvalid="skip")
    model = rf.fit(df)
    data = model.transform(df).select("label", "features")
    names = feature_names(data)
    scratch_dir(df.sparkSession)
    return data.checkpoint(), names


_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")
_PRED = re.compile(r"^(\s*)Predict: (.+)$")


def _tree_rules(debug: str, names: list[str]):
    """Leaves of a Spark tree as (leaf_id, rule, prediction) from its text form."""
    path, rows = [], []
    for line in debug.splitlines()[1:]:
        m = _SPLIT.match(line)
        if m:
            depth = len(m.group(1)) // 1
            feat = names[int(m.group(3))] if int(m.group(3)) < len(names) else f"feature {m.group(3)}"
            cond = f"{feat} {m.group(4)} {m.group(5)}"
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, cond))
            continue
        m = _PRED.match(line)
        if m:
            rows.append((len(rows) + 1, " AND ".join(c for _, c in path) or "TRUE", float(m.group(2))))
    return rows


def tree_fit(df: DataFrame, formula: str, depth: int = 5, min_n: int = 20, kind: str = "classification",
             max_bins: int = 32, seed: int = 42) -> DataFrame:
    """Decision tree; rows are the leaves: rule (conjunction of splits), prediction."""
    data, names = _prepared(df, formula)
    est = (DecisionTreeClassifier if kind == "classification" else DecisionTreeRegressor)(
        maxDepth=depth, minInstancesPerNode=min_n, maxBins=max_bins, seed=seed)
    m = est.fit(data)
    rows = _tree_rules(m.toDebugString, names)
    return df.sparkSession.createDataFrame(rows, "leaf_id int, rule string, prediction double")


def forest_fit(df: DataFrame, formula: str, n_trees: int = 50, depth: int = 5, seed: int = 42,
               kind: str = "classification") -> DataFrame:
    """Random forest; rows are (feature, importance), importances summing to 1."""
    data, names = _prepared(df, formula)
    est = (RandomForestClassifier if kind == "classification" else RandomForestRegressor)(
        numTrees=n_trees, maxDepth=depth, seed=seed)
    m = est.fit(data)
    imp = m.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                                           "feature string, importance double")


def svm_linear(df: DataFrame, formula: str, reg: float = 0.01, max_iter: int = 100) -> DataFrame:
    """Linear max-margin classifier (hinge loss, L2); rows (term, coefficient)."""
    data, names = _prepared(df, formula)
    m = LinearSVC(regParam=reg, maxIter=max_iter, standardization=True).fit(data)
    rows = [("(Intercept)", float(m.intercept))] + [(n, float(c)) for n, c in zip(names, m.coefficients)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def glm_fit(df: DataFrame, formula: str, family: str = "binomial", link: str | None = None) -> DataFrame:
    """GLM by iteratively reweighted least squares (Spark ML); rows (term,
    estimate, std_error, z_value) plus deviance and AIC."""
    data, names = _prepared(df, formula)
    kw = {"family": family, "maxIter": 50}
    if link:
        kw["link"] = link
    m = GeneralizedLinearRegression(**kw).fit(data)
    s = m.summary
    se = list(s.coefficientStandardErrors)
    tv = list(s.tValues)
    dev, aic = float(s.deviance), float(s.aic)
    est = list(m.coefficients) + [m.intercept]
    terms = names + ["(Intercept)"]
    rows = [(t, float(e), float(s_), float(z), dev, aic) for t, e, s_, z in zip(terms, est, se, tv)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, z_value double, deviance double, aic double")


def cross_validate(df: DataFrame, formula: str, fold_col: str, model: str = "tree",
                   grid: dict | None = None, metric: str = "areaUnderROC") -> DataFrame:
    """k-fold cross-validation over a parameter grid with given folds (e.g.
    from ``split_stratified``); rows: one per setting with its mean metric. ``lm`` and ``glm`` (logistic) have no
    grid and no fit per fold: their mean root mean square error comes from sums per fold (``crossval``)."""
    if model in ("lm", "glm"):
        data, label, names = design(df, formula, [fold_col])
        folds = (cv_linear if model == "lm" else cv_logistic)(data, label, names, fold_col)
        return folds.agg(F.lit(model).alias("setting"), F.avg("rmse").alias("metric"))
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label", handleInvalid="skip")
    if model == "tree":
        est = DecisionTreeClassifier(seed=42)
    elif model == "forest":
        est = RandomForestClassifier(seed=42)
    else:
        raise ValueError(f"model={model!r}")
    pipe = Pipeline(stages=[rf, est])
    gb = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [2, 4]}).items():
        gb = gb.addGrid(est.getParam(name), values)
    maps = gb.build()
    ev = BinaryClassificationEvaluator(metricName=metric)
    scratch_dir(df.sparkSession)
    data = df.withColumn(fold_col, F.col(fold_col).cast("int")).checkpoint()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=int(data.agg(F.max(fold_col)).first()[0]) + 1, seed=42,
                        parallelism=max(1, len(maps)))
    m = cv.fit(data)
    metrics = list(m.avgMetrics)
    rows = [(", ".join(f"{p.name}={v}" for p, v in pm.items()), float(v)) for pm, v in zip(maps, metrics)]
    return df.sparkSession.createDataFrame(rows, "setting string, metric double")
