"""Modelling-frame preparation fitted on training rows only (optionally per fold):
missing flags, median / most-frequent imputation, standardisation (population
std), one-hot encoding with unknown levels → all zeros, balanced class weights.

Fitted parameters are small grouped aggregates kept as DataFrames (one row per
fit, keyed by ``by`` such as (rep, fold)) and joined back — nothing per row passes
through the driver. Only one-hot level names are collected, since they become
column names (bounded by ``max_levels``; more levels raise instead of truncating).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import exact_quantiles
from .sizing import with_scalars


def feature_roles(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns from the schema. Boolean columns are neither
    and would be dropped silently by a column-type selector, so they raise."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.BooleanType):
            raise TypeError(f"boolean feature {f.name!r}: cast it to int or string first")
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
    return num, cat


def measured_roles(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, n_values, role) of every column, decided by its values in one pass: 'numeric' when
    each non-NULL value reads as a number, 'empty' without values, else 'categorical'."""
    cols = [c for c in df.columns if c not in exclude]
    aggs = []
    for c in cols:
        q = f"`{c}`"
        aggs += [F.count(F.col(q)).alias(f"n_{c}"), F.count_if(F.col(q).isNotNull() & F.expr(f"try_cast({q} AS double)").isNull()).alias(f"t_{c}")]
    one = df.agg(*aggs)
    role = lambda c: F.when(F.col(f"n_{c}") == 0, "empty").when(F.col(f"t_{c}") == 0, "numeric").otherwise("categorical")
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_values"), role(c).alias("role")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<c>_missing`` = 1 where c is NULL (added before imputation)."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate) for every column in one aggregation pass, highest first."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    stacked = one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in df.columns])).alias("s")
    )
    return stacked.select("s.column", "s.null_rate").orderBy(F.desc("null_rate"), "column")


def drop_sparse(df: DataFrame, max_null_rate: float, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose null rate exceeds ``max_null_rate`` (one pass to measure;
    the column list is a handful of names)."""
    rates = null_rates(df).where(F.col("null_rate") > max_null_rate).select("column").collect()
    return df.drop(*[r[0] for r in rates if r[0] not in set(keep)])


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str], cast: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast(cast).alias("_val")) for c in cols])
    return df.select(*by, F.explode(arr).alias("_s")).select(*by, "_s._col", "_s._val")


def fit_medians(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., _col, median) — exact medians per column (and fit group)."""
    long = _long(train, cols, by, "double")
    q = exact_quantiles(long, "_val", [0.5], [*by, "_col"], names=["median"])
    return q


def fit_modes(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., _col, mode) — most frequent non-NULL value, smallest on ties."""
    long = _long(train, cols, by, "string").where(F.col("_val").isNotNull())
    cnt = long.groupBy(*by, "_col", "_val").agg(F.count(F.lit(1)).alias("_n"))
    return cnt.groupBy(*by, "_col").agg(F.min_by("_val", F.struct(-F.col("_n"), F.col("_val"))).alias("mode"))


def _wide(params: DataFrame, by: Sequence[str], value: str, prefix: str, cols: Sequence[str]) -> DataFrame:
    names = list(cols)
    p = params.groupBy(*by).pivot("_col", names).agg(F.first(value))
    return p.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in names])


def _attach(df: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    # a fit without groups is exactly one row of parameters
    return df.join(params, list(by)) if by else with_scalars(df, params)


def impute(df: DataFrame, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median-impute numeric and mode-impute categorical columns with values fitted
    on ``train`` (per ``by`` group)."""
    out = df
    if numeric:
        med = _wide(fit_medians(train, numeric, by), by, "median", "_med_", numeric)
        out = _attach(out, med, by)
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in numeric})
        out = out.drop(*[f"_med_{c}" for c in numeric])
    if categorical:
        mode = _wide(fit_modes(train, categorical, by), by, "mode", "_mode_", categorical)
        out = _attach(out, mode, by)
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in categorical})
        out = out.drop(*[f"_mode_{c}" for c in categorical])
    return out


def standardize(df: DataFrame, train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x − mean) / std with the population std of ``train``; a zero-variance column
    is only centred. Fit on already-imputed training rows."""
    if not cols:
        return df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    params = train.groupBy(*by).agg(*aggs)
    out = _attach(df, params, by)
    sd = lambda c: F.when((F.col(f"_sd_{c}") == 0) | F.col(f"_sd_{c}").isNull(), F.lit(1.0)).otherwise(F.col(f"_sd_{c}"))
    out = out.withColumns({c: (F.col(c) - F.col(f"_mu_{c}")) / sd(c) for c in cols})
    return out.drop(*[x for c in cols for x in (f"_mu_{c}", f"_sd_{c}")])


def one_hot_levels(train: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list]:
    """Sorted non-NULL training levels of each column. They become column names, so the
    driver must know them; a column of more than ``max_levels`` levels raises."""
    found = {}
    for c in cols:
        found[c] = [r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(max_levels + 1).collect()]
        if len(found[c]) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels; encode it another way")
    return found


def one_hot_encode(df: DataFrame, levels: dict[str, list]) -> tuple[DataFrame, list[str]]:
    """``<c>_<level>`` 0/1 columns for the given levels, replacing each ``c``; a level
    not listed gives all zeros. Returns the table and the new columns' names."""
    cols = {f"{c}_{lv}": F.coalesce(F.col(c) == lv, F.lit(False)).cast("int") for c, lvs in levels.items() for lv in lvs}
    return df.withColumns(cols).drop(*levels), list(cols)


def one_hot(df: DataFrame, train: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> DataFrame:
    """``<c>_<level>`` 0/1 columns for every training level (sorted); a level not
    seen in training gives all zeros; no level is dropped. Replaces ``c``."""
    return one_hot_encode(df, one_hot_levels(train, cols, max_levels))[0]


def balanced_weights(
    df: DataFrame, train: DataFrame, label: str, out: str = "weight", by: Sequence[str] = (), mass: str | None = None
) -> DataFrame:
    """Class weight n / (n_classes · n_class) from ``train``, attached to ``df``. With ``mass`` a
    row counts as much as that column says (the share of a soft label)."""
    one = F.count(F.lit(1)) if mass is None else F.sum(mass)
    cls = train.groupBy(*by, label).agg(one.alias("_nc"))
    tot = train.groupBy(*by).agg(one.alias("_nt"), F.countDistinct(label).alias("_k"))
    w = (cls.join(tot, list(by)) if by else with_scalars(cls, tot)).select(
        *by, label, (F.col("_nt") / (F.col("_k") * F.col("_nc"))).alias(out)
    )
    return df.join(w, [*by, label], "left")


def soft_rows(df: DataFrame, label: str, mass: str = "mass") -> DataFrame:
    """Each row with a fractional label y in [0, 1] as two rows: label 1 with mass y and label 0 with
    mass 1 − y (parts without mass are left out; a NULL label stays one row of mass 1)."""
    y = F.col(label).cast("double")
    parts = F.when(y.isNull(), F.array(F.struct(y.alias("y"), F.lit(1.0).alias("m")))).otherwise(
        F.array(F.struct(F.lit(1.0).alias("y"), y.alias("m")), F.struct(F.lit(0.0).alias("y"), (1 - y).alias("m")))
    )
    out = df.withColumn("_part", F.explode(F.filter(parts, lambda s: s["m"] > 0)))
    return out.withColumns({label: F.col("_part.y"), mass: F.col("_part.m")}).drop("_part")
