"""Alarms of sources and models against their own trailing history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_alarms(counts: DataFrame, key: str = "key", day: str = "day", n: str = "n", days: int = 14, percent: int = 30, least_runs: int = 3, least_median: int = 10) -> DataFrame:
    """quiet and shrunk for each run of a source, against its runs of the days before; a run is never its own baseline.

    Counts are compared as whole numbers: n * 100 < median * percent, with the
    median doubled so it stays whole.
    """
    at = F.unix_date(day)
    before = Window.partitionBy(key).orderBy(at).rangeBetween(-days, -1)
    history = F.collect_list(F.when(F.col(n) > 0, F.col(n))).over(before)
    df = counts.withColumns({"high": F.coalesce(F.max(n).over(before), F.lit(0)), "__past": F.array_sort(history)})
    size = F.size("__past")
    double = F.try_element_at("__past", F.floor((size + 1) / 2).cast("int")) + F.try_element_at("__past", (F.floor(size / 2) + 1).cast("int"))
    df = df.withColumns({"runs": size, "__double": F.when(size > 0, double)})
    shrunk = (F.col("runs") >= least_runs) & (F.col("__double") >= 2 * least_median) & (F.col(n) > 0) & (F.col(n) * 200 < F.col("__double") * percent)
    return df.withColumns({"quiet": (F.col(n) == 0) & (F.col("high") > 0), "shrunk": F.coalesce(shrunk, F.lit(False))}).drop("__past", "__double")


def rate_alarms(runs: DataFrame, rates: list[str], key: str = "key", at: str = "day", total: str = "postings", trailing: int = 5, least_runs: int = 3, factor: int = 2, least: int = 5) -> DataFrame:
    """Rates of a run above factor times their median over the runs before it, one row for each rate that is."""
    long = runs.filter(F.col(total) > 0).select(key, at, total, F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("affected")) for r in rates])).alias("x")).select(key, at, total, "x.*")
    per = Window.partitionBy(key, "rate").orderBy(at).rowsBetween(-trailing, -1)
    past = F.array_sort(F.collect_list(F.col("affected") / F.col(total)).over(per))
    long = long.withColumn("__past", past)
    size = F.size("__past")
    median = (F.try_element_at("__past", F.floor((size + 1) / 2).cast("int")) + F.try_element_at("__past", (F.floor(size / 2) + 1).cast("int"))) / 2
    long = long.withColumns({"runs": size, "median": F.when(size > 0, median)})
    flagged = (F.col(total) >= least) & (F.col("runs") >= least_runs) & (F.col("affected") > factor * F.col("median") * F.col(total)) & ((F.col("median") > 0) | (F.col("affected") >= least))
    return long.filter(flagged).drop("__past")


def failure(errors: Column, attempted: Column, percent: int = 20) -> Column:
    """Whether a model failed as a whole."""
    return (attempted > 0) & (errors * 100 > attempted * percent)
