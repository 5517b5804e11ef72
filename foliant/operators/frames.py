"""Pivots and dataframe recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c)


def pivot_flat(df: DataFrame, rows: list[str], values: dict[str, str]) -> DataFrame:
    """Groups by rows, with keys as text; values: column to method, over numeric cells, rounded half-even to 2."""
    out = [F.coalesce(F.bround(METHODS[m](F.expr(f"try_cast(`{c}` AS double)")).cast("double"), 2), F.lit(0.0)).alias(f"{m}_{c}") for c, m in values.items()]
    return df.select(*[_key(c) for c in rows], *[F.col(c) for c in values]).groupBy(*rows).agg(*out)


def pivot_cross(df: DataFrame, rows: list[str], column: str, values: dict[str, str] | str, method: str | None = None, among: list[str] | None = None, most: int = 1000) -> DataFrame:
    """A matrix of rows by the values of one column; missing cells are 0.

    values: column to method (or a column, with ``method``). Columns are named by the value, and with several value
    columns by "value (column method)". Without ``among`` the values are all that occur, in order of text; more than
    ``most`` of them are an error, since each becomes a column.
    """
    values = {values: method} if isinstance(values, str) else values
    keyed = df.select(*[_key(c) for c in rows], _key(column).alias("_at"), *[F.col(c) for c in values])
    if among is None:
        among = sorted(r["_at"] for r in keyed.select("_at").distinct().limit(most + 1).collect())
        if len(among) > most:
            raise ValueError(f"more than {most} columns")
    name = lambda v, c, m: v if len(values) == 1 else f"{v} ({c} {m})"
    cell = lambda v, c, m: F.coalesce(F.bround(METHODS[m](F.when(F.col("_at") == v, F.expr(f"try_cast(`{c}` AS double)"))).cast("double"), 2), F.lit(0.0))
    return keyed.groupBy(*rows).agg(*[cell(v, c, m).alias(name(v, c, m)) for v in among for c, m in values.items()])


def quantiles(df: DataFrame, value: str, shares: list[float], rows: int = 100_000) -> list[float | None]:
    """Exact quantiles, linear between ranks. Brackets around each rank are narrowed by approximate percentiles until they
    hold at most ``rows`` values or one; only such a bracket is sorted, and no task holds all distinct values."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)

    def at(rank: int) -> float:
        lo, hi = low, high
        while True:
            inside = v.where((F.col("v") >= lo) & (F.col("v") <= hi))
            below, here = v.agg(F.count_if(F.col("v") < lo), F.count_if((F.col("v") >= lo) & (F.col("v") <= hi))).first()
            if lo == hi:
                return lo
            if here <= rows:
                return inside.orderBy("v").offset(rank - below).limit(1).first()["v"]
            share = (rank - below) / max(1, here - 1)
            a, b = inside.agg(F.percentile_approx("v", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)).first()[0]
            under, upto = v.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
            if not (under <= rank < upto) or (a, b) == (lo, hi):  # the guess was off, or ties don't narrow: halve by value
                a = b = (lo + hi) / 2
                under, upto = v.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
                if rank < under:
                    a, b = lo, inside.where(F.col("v") < a).agg(F.max("v")).first()[0]
                elif rank >= upto:
                    a, b = inside.where(F.col("v") > b).agg(F.min("v")).first()[0], hi
            lo, hi = a, b

    out = []
    for s in shares:
        place = s * (n - 1)
        k = int(place)
        x = at(k)
        out.append(x + (place - k) * (at(min(k + 1, n - 1)) - x) if place > k else x)
    return out


def with_margins(df: DataFrame, row: str, column: str, value: str, among: list[str]) -> DataFrame:
    """Sums by row and column with totals named All."""
    cube = df.cube(row, column).agg(F.grouping(row).alias("_gr"), F.grouping(column).alias("_gc"), F.sum(value).alias("v"))
    named = cube.select(F.when(F.col("_gr") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("_gc") == 1, "All").otherwise(F.col(column)).alias(column), "v")
    return named.groupBy(row).pivot(column, [*among, "All"]).agg(F.first("v"))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "running_total") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("rolling_mean", F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def pct_change(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("pct_change", (F.col(value) - before) / F.nullif(before, F.lit(0.0)))


def monthly(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Sum and count of each month from the first to the last, empty months too."""
    month = F.date_trunc("month", F.col(ts))
    sums = df.groupBy(month.alias("month")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    spine = sums.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(sums, "month", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})


def outlier_bounds(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """One row (low, high): the quartiles less and plus k times their distance."""
    q1, q3 = quantiles(df, value, [0.25, 0.75])
    low, high = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return df.sparkSession.range(1).select(F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))


def without_outliers(df: DataFrame, value: str) -> DataFrame:
    return df.crossJoin(F.broadcast(outlier_bounds(df, value))).where(F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")  # one row is broadcast


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, distinct rows' excess and null counts, in one row."""
    rows = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    return rows.crossJoin(df.select(*columns).distinct().agg(F.count("*").alias("n_distinct"))).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes, median and sample skewness of a column."""
    v, n = F.col(value), F.count(value).cast("double")
    median = F.lit(quantiles(df, value, [0.5])[0]).cast("double")
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), median.alias("median"), F.max(v).alias("high"), (F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))


def run_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(*[F.bround(x, 4).alias(n) for n, x in (("mean", F.avg(v)), ("stddev", F.coalesce(F.stddev_samp(v), F.lit(0.0))), ("min", F.min(v)), ("max", F.max(v)))])


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join on key with the change and its share."""
    both = old.select(key, F.col(value).alias(f"{value}_old")).join(new.select(key, F.col(value).alias(f"{value}_new")), key)
    change = F.col(f"{value}_new") - F.col(f"{value}_old")
    return both.withColumns({"change": change, "pct": change / F.nullif(F.col(f"{value}_old"), F.lit(0.0)) * 100})


def split_holdout(df: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """A column ``held``: an exact share of each stratum, one row at least, in order of the MD5 of key and seed."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key)
    size = F.count("*").over(Window.partitionBy(stratum))
    return df.withColumn("held", F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(size * share)))
