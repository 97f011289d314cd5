"""Statistics of experiments: groups, ranks, intervals, pooled effects, streaks."""

from __future__ import annotations

import math
import random
import statistics
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symsift.functions.text import any_of
from symsift.storage import scratch


def exclusive_quantile(values: Column, q: float) -> Column:
    """Position q * (n + 1) of a sorted array, between neighbours in proportion, kept inside."""
    n = F.size(values)
    at = F.lit(q) * (n + 1)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(at).cast("int")))
    part = at - j
    return F.get(values, j - 1) * (1 - part) + F.get(values, j) * part


def group_summary(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """n, mean, median, inclusive and exclusive quartiles, spread and extremes of each arm.

    Quantiles come from counts per value in order, so neither a group nor its
    different values are ever held in one task.
    """
    v = F.col(value)
    basic = rows.groupBy(arm).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.sum(v).alias("total"), F.stddev_pop(v).alias("pstdev"), F.stddev_samp(v).alias("stdev"), F.exp(F.avg(F.when(v > 0, F.ln(v)))).alias("geomean"),
    )
    found = quantiles(rows, [arm], value, {"median": 0.5, "p90": 0.9}, {"q1": 0.25, "q3": 0.75})
    return basic.join(found, arm).select(arm, "n", "mean", "median", "p90", "low", "high", "total", "pstdev", "stdev", "geomean", "q1", "q3")


def exclusive_quartiles(rows: DataFrame, arm: str, value: str) -> DataFrame:
    return quantiles(rows, [arm], value, {}, {"q1": 0.25, "q3": 0.75})


def quantiles(rows: DataFrame, by: list[str], value: str, inclusive: dict[str, float], exclusive: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles of each group, at position q * (n - 1) + 1 (inclusive) or q * (n + 1), kept inside, of its values in order.

    Counts per value are sorted over all machines and stored with the number of
    their part, so a part's rows are the same whenever it is read.  A table of
    the parts' totals tells which parts hold a wanted rank; only these, eight a
    group here, are read on, each in a task of its own.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    path = scratch(rows.sparkSession, "counts")
    counts.orderBy(*by, "v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    totals = stored.groupBy(*by, "_part").agg(F.sum("c").alias("_c"))
    group = Window.partitionBy(*by)
    totals = totals.select(*by, "_part", "_c", (F.sum("_c").over(group.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(group).alias("n"))
    places, out = [], []
    for kinds, offset in ((inclusive, -1), (exclusive or {}, 1)):
        for name, q in kinds.items():
            at = F.lit(q) * (F.col("n") + offset) + (1 if offset < 0 else 0)
            low = F.floor(at) if offset < 0 else F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(at)))
            places += [low, low + 1]
            held = lambda k: F.max(F.when((F.col("_last") >= k) & (F.col("_last") - F.col("c") < k), F.col("v")))
            part = F.max(at - low)
            value_at = held(low) * (1 - part) + held(low + 1) * part
            out.append((F.when(part == 0, held(low)).otherwise(value_at) if offset < 0 else value_at).alias(name))
    holds = [(F.col("_before") < k) & (k <= F.col("_before") + F.col("_c")) for k in places]
    wanted = totals.where(any_of(holds)).drop("_c")
    order = Window.partitionBy(*by, "_part").orderBy("v")
    known = stored.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_part").alias("_p"), "v", "c")
    same = [F.col(f"_{b}").eqNullSafe(F.col(b)) for b in by]  # null is a group as well
    ranked = known.join(wanted, reduce(and_, same, F.col("_p") == F.col("_part"))).withColumn("_last", F.col("_before") + F.sum("c").over(order))
    return ranked.groupBy(*by).agg(*out)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k out of n."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def average_ranks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts per value with the average rank of its ties, and the tie term."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("ties"))
    before = F.sum("ties").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("v")) - F.col("ties")
    return counts.select(*by, "v", "ties", (before + (F.col("ties") + 1) / 2).alias("rank"), (F.col("ties") ** 3 - F.col("ties")).alias("tie_term"))


def mann_whitney(rows: DataFrame, arm: str, value: str, a, b, tie_corrected: bool = True) -> DataFrame:
    """U of arm a against arm b, its normal z, and the rank-biserial correlation, from counts per value."""
    both = rows.where(F.col(arm).isin(a, b) & F.col(value).isNotNull())
    counts = both.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(arm) == a).alias("ca"), F.count("*").alias("ties"))
    before = F.sum("ties").over(Window.partitionBy(F.lit(1)).orderBy("v")) - F.col("ties")  # one row per different value
    t = counts.withColumn("rank", before + (F.col("ties") + 1) / 2)
    s = t.agg(F.sum(F.col("ca") * F.col("rank")).alias("ra"), F.sum("ca").alias("na"), F.sum(F.col("ties") - F.col("ca")).alias("nb"), F.sum(F.col("ties") ** 3 - F.col("ties")).alias("tt"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    sigma = F.sqrt(na * nb / 12 * (n + 1 - (F.col("tt") / (n * (n - 1)) if tie_corrected else F.lit(0.0))))
    return s.select(na.alias("na"), nb.alias("nb"), u.alias("u"), ((u - na * nb / 2) / sigma).alias("z"), (2 * u / (na * nb) - 1).alias("rank_biserial"))


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal z, by the rational approximation of erfc (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    rx = average_ranks(rows, x).select(F.col("v").alias(x), F.col("rank").alias("rx"))
    ry = average_ranks(rows, y).select(F.col("v").alias(y), F.col("rank").alias("ry"))
    return rows.join(rx, x).join(ry, y).agg(F.corr("rx", "ry").alias("rho"))


def bootstrap_median_difference(rows: DataFrame, pair: str, arm: str, value: str, a, b, times: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of the difference of medians by resampling, for each pair; groups are experiments of a few runs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = (pdf.loc[pdf[arm] == k, value].dropna().tolist() for k in (a, b))
        if not xs or not ys:
            return pd.DataFrame({pair: pdf[pair].head(1), "delta": [None], "low": [None], "high": [None]})
        rng = random.Random(seed)
        draws = sorted(statistics.median(rng.choices(ys, k=len(ys))) - statistics.median(rng.choices(xs, k=len(xs))) for _ in range(times))
        return pd.DataFrame({pair: pdf[pair].head(1), "delta": [statistics.median(ys) - statistics.median(xs)], "low": [draws[int(0.025 * times)]], "high": [draws[int(0.975 * times) - 1]]})

    kind = rows.schema[pair].dataType.simpleString()
    return rows.select(pair, arm, F.col(value).cast("double").alias(value)).groupBy(pair).applyInPandas(one, f"{pair} {kind}, delta double, low double, high double")


def log_ratio(rows: DataFrame, pair: str, arm: str, value: str, a, b, times: int = 2000, seed: int = 42) -> DataFrame:
    """ln(median b / median a) of each pair with its bootstrap standard error."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = (pdf.loc[(pdf[arm] == k) & (pdf[value] > 0), value].tolist() for k in (a, b))
        if not xs or not ys:
            return pd.DataFrame({pair: pdf[pair].head(1), "effect": [None], "se": [None]})
        rng = random.Random(seed)
        effect = lambda p, q: math.log(statistics.median(q) / statistics.median(p))
        draws = [effect(rng.choices(xs, k=len(xs)), rng.choices(ys, k=len(ys))) for _ in range(times)]
        return pd.DataFrame({pair: pdf[pair].head(1), "effect": [effect(xs, ys)], "se": [statistics.stdev(draws)]})

    kind = rows.schema[pair].dataType.simpleString()
    return rows.select(pair, arm, F.col(value).cast("double").alias(value)).groupBy(pair).applyInPandas(one, f"{pair} {kind}, effect double, se double")


def pool(effects: DataFrame) -> DataFrame:
    """Inverse-variance mean of (effect, se) with its interval, Q and I-squared."""
    w = 1 / (F.col("se") * F.col("se"))
    e = F.col("effect")
    s = effects.where("se > 0").agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * e).alias("swe"), F.sum(w * e * e).alias("swee"))
    mean, se = F.col("swe") / F.col("sw"), 1 / F.sqrt("sw")
    q = F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw")
    i2 = F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0)
    return s.select("k", mean.alias("effect"), (mean - 1.96 * se).alias("low"), (mean + 1.96 * se).alias("high"), q.alias("q"), i2.alias("i2"), (F.exp(mean) * 100 - 100).alias("pct"))


def streaks(rows: DataFrame, run: str, order: str, tool: str) -> DataFrame:
    """The longest stretch of one tool in each run: gaps and islands."""
    all_, own = Window.partitionBy(run).orderBy(order), Window.partitionBy(run, tool).orderBy(order)
    island = F.row_number().over(all_) - F.row_number().over(own)
    return rows.withColumn("_i", island).groupBy(run, tool, "_i").agg(F.count("*").alias("n")).groupBy(run, tool).agg(F.max("n").alias("longest"))


def thirds(rows: DataFrame, run: str, order: str) -> DataFrame:
    """Each row's third of its run: min(2, i * 3 // n)."""
    w = Window.partitionBy(run)
    i = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("_i", i).withColumn("_n", F.count("*").over(w)).withColumn("third", F.least(F.lit(2), F.floor(F.col("_i") * 3 / F.col("_n")).cast("int"))).drop("_i", "_n")


def debounced(events: DataFrame, key: str, ts: str, kind: str, order: str, gap_ms: int, first: bool = False) -> DataFrame:
    """Bursts of events of a key, closed by a silence of ``gap_ms``; the last (or first) kind of a burst wins."""
    w = Window.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    apart = micros - F.lag(micros).over(w)
    burst = F.sum(F.when(apart.isNull() | (apart > gap_ms * 1000), 1).otherwise(0)).over(w)
    pick = (F.min_by if first else F.max_by)(F.col(kind), F.struct(ts, order))
    return events.withColumn("burst", burst).groupBy(key, "burst").agg(F.count("*").alias("n"), pick.alias("kind"), F.min(ts).alias("opened"), F.max(ts).alias("closed"))
