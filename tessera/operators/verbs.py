"""Table verbs: projection, recoding, filtering, distinct, sorting, sampling,
set operations and stacking. Thin over the DataFrame API on purpose: their
value is argument checks and fixed null, tie and bin rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list, numeric_columns, require_columns
from tessera.operators.groupjoin import join_rows_by
from tessera.operators.ranking import cut_bin, quantiles


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _expr(e) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def order_cols(order) -> list[Column]:
    """``order`` items: a column name (ascending, NULLs first), ``"-name"``
    (descending, NULLs last) or a Column with its own direction."""
    out = []
    for o in as_list(order):
        if isinstance(o, str) and o.startswith("-"):
            out.append(F.col(o[1:]).desc_nulls_last())
        elif isinstance(o, str):
            out.append(F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


# ---------------------------------------------------------------- projection
def select_rename(df: DataFrame, cols=None, rename: dict | None = None) -> DataFrame:
    """Columns by name, or by type with ``"numeric"``/``"string"``; then renamed."""
    if cols in ("numeric", "string"):
        want = numeric_columns(df) if cols == "numeric" else [
            f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    else:
        want = as_list(cols) or df.columns
    require_columns(df, *want)
    rename = rename or {}
    require_columns(df, *rename)
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in want])


def mutate(df: DataFrame, exprs: dict) -> DataFrame:
    """Add or replace columns; later expressions may use earlier ones."""
    out = df
    for name, e in exprs.items():
        out = out.withColumn(name, _expr(e))
    return out


def mutate_across(df: DataFrame, cols, fn, names: str = "{col}") -> DataFrame:
    """Apply ``fn(Column) -> Column`` to each column in one projection."""
    cols = as_list(cols)
    require_columns(df, *cols)
    new = {names.format(col=c): fn(F.col(c)) for c in cols}
    keep = [F.col(c) for c in df.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def filter_rows(df: DataFrame, *preds) -> DataFrame:
    """Conjunction of predicates; a NULL predicate drops the row."""
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, [_expr(p) for p in preds]))


def distinct_rows(df: DataFrame, keys=None, order=None) -> DataFrame:
    """Unique rows; or, with ``keys``, the first row per key under ``order``.

    The keyed form is ``row_number() = 1``, which Spark plans with a partial
    WindowGroupLimit before the shuffle, so a hot key sends at most one row per
    map partition across the network.
    """
    if not keys:
        return df.distinct()
    keys = as_list(keys)
    require_columns(df, *keys)
    w = Window.partitionBy(*keys).orderBy(*order_cols(order or keys))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def case_recode(df: DataFrame, col: str, cases, default=None, name: str | None = None) -> DataFrame:
    """``cases`` = [(predicate, value), ...] checked in order; first true wins."""
    expr = None
    for pred, val in cases:
        pred = _expr(pred)
        val = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(pred, val) if expr is None else expr.when(pred, val)
    d = default if isinstance(default, Column) else F.lit(default)
    return df.withColumn(name or col, d if expr is None else expr.otherwise(d))


def null_handling(df: DataFrame, drop=None, fill: dict | None = None,
                  sentinel: dict | None = None, coalesce: dict | None = None) -> DataFrame:
    """Sentinel values to NULL first, then coalesce chains, fills and drops.

    ``sentinel`` {col: value}; ``coalesce`` {new: [cols...]}; ``fill`` {col: value};
    ``drop`` list of columns that must be non-NULL (``"any"`` for all)."""
    out = df
    for c, v in (sentinel or {}).items():
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(v)))
    for new, cols in (coalesce or {}).items():
        out = out.withColumn(new, F.coalesce(*[_col(c) for c in cols]))
    if fill:
        out = out.fillna(fill)
    if drop == "any":
        out = out.dropna(how="any")
    elif drop:
        out = out.dropna(subset=as_list(drop))
    return out


def split_column(df: DataFrame, col: str, into, sep: str) -> DataFrame:
    """One text column into several; missing pieces are NULL. ``sep`` is literal."""
    into = as_list(into)
    require_columns(df, col)
    pieces = [F.nullif(F.split_part(F.col(col), F.lit(sep), F.lit(i + 1)), F.lit("")).alias(n)
              for i, n in enumerate(into)]
    return df.select("*", *pieces)


def unite_columns(df: DataFrame, cols, into: str, sep: str = "_") -> DataFrame:
    """Several columns into one text column; NULL pieces skipped."""
    cols = as_list(cols)
    require_columns(df, *cols)
    return df.withColumn(into, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))


def bin_fixed(df: DataFrame, col: str, breaks, name: str = "bin", labels=None) -> DataFrame:
    """Right-closed intervals (b[i-1], b[i]] numbered 1..len(breaks)-1; values
    outside the breaks, and NULL, give NULL. ``labels`` replaces the number."""
    breaks = [float(b) for b in breaks]
    if sorted(breaks) != breaks or len(set(breaks)) != len(breaks):
        raise ValueError("breaks must be strictly increasing")
    x = F.col(col)
    expr = None
    for i in range(1, len(breaks)):
        val = F.lit(labels[i - 1] if labels else i)
        cond = (x > F.lit(breaks[i - 1])) & (x <= F.lit(breaks[i]))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return df.withColumn(name, expr)


def bin_equal_freq(df: DataFrame, col: str, n: int, name: str = "bin", by=(), sketch: int | None = None) -> DataFrame:
    """Quantile bins: cut points are exact quantiles at 1/n..(n-1)/n (per group
    in ``by``), or those of KLL sketches of ``sketch`` items; bin = 1 + number of cut points strictly below the value."""
    by = as_list(by)
    names = [f"_cut{i}" for i in range(1, n)]
    cuts = quantiles(df, col, [i / n for i in range(1, n)], by=by, names=names, sketch=sketch)
    joined = join_rows_by(df, cuts, by)
    return joined.withColumn(name, cut_bin(F.col(col), [F.col(c) for c in names])).drop(*names)


# ---------------------------------------------------------- sorting, sampling
def arrange_limit(df: DataFrame, order, n: int | None = None) -> DataFrame:
    """Total order (plans as TakeOrderedAndProject when ``n`` is given)."""
    out = df.orderBy(*order_cols(order))
    return out.limit(n) if n is not None else out


def slice_top(df: DataFrame, by, order, n: int, ties: bool = False) -> DataFrame:
    """Top ``n`` rows per group; ``ties=True`` keeps every row tied with the n-th."""
    by = as_list(by)
    w = Window.partitionBy(*by).orderBy(*order_cols(order))
    fn = F.rank() if ties else F.row_number()
    return df.withColumn("_r", fn.over(w)).where(F.col("_r") <= n).drop("_r")


def seeded_hash(key: str, seed: int) -> Column:
    """A whole number below 2^60 from the md5 of ``key|seed``, the same in any engine; a NULL key hashes like ""."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, frac, by: str | None = None, seed: int = 42,
                key: str | None = None) -> DataFrame:
    """Bernoulli sample; stratified when ``frac`` is a dict keyed by ``by`` values.

    With ``key``, a row is kept when a seeded hash of the key falls below the
    fraction, so the sample is repeatable across runs and partitionings."""
    if key is not None:
        require_columns(df, key)
        u = seeded_hash(key, seed) / F.lit(2.0 ** 60)
        if isinstance(frac, dict):
            f = F.lit(0.0)
            for v, p in frac.items():
                f = F.when(F.col(by) == F.lit(v), F.lit(float(p))).otherwise(f)
            return df.where(u < f)
        return df.where(u < F.lit(float(frac)))
    if isinstance(frac, dict):
        return df.sampleBy(by, fractions=frac, seed=seed)
    return df.sample(withReplacement=False, fraction=float(frac), seed=seed)


# ------------------------------------------------------------ set operations
def set_union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    u = a.unionByName(b)
    return u if all else u.distinct()


def set_intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.intersectAll(b) if all else a.intersect(b)


def set_except(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(b) if all else a.subtract(b)


def bind_rows(dfs, id_col: str | None = None, names=None) -> DataFrame:
    """Stack by column name; missing columns are NULL; optional source tag."""
    dfs = list(dfs)
    names = list(names) if names else [str(i + 1) for i in range(len(dfs))]
    tagged = [d.withColumn(id_col, F.lit(n)) if id_col else d for d, n in zip(dfs, names)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
