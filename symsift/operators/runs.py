"""Experiments as tables: runs, evaluations, tool calls and trajectories.

A run is a row (arm, instance, rep, ...); a call or turn is a row of a run with
its order.  Every function takes the names of the columns it works on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_evaluation(runs: DataFrame, evals: DataFrame, on: str | Sequence[str], resolved: str, missing: str = "not_evaluated") -> DataFrame:
    """Runs with ``outcome`` and ``success``; a run without evaluation is kept and counts as no success."""
    c = F.col(resolved)
    return runs.join(evals, on, "left").withColumn("outcome", F.when(c.isNull(), missing).when(c == 1, "resolved").otherwise("failed")).withColumn("success", F.coalesce(c, F.lit(0)))


def with_attribute(runs: DataFrame, other: DataFrame, on: Sequence[str], value: str, pick=F.max) -> DataFrame:
    """Runs with one value of another table on the same keys, null where it has none; keys there may repeat."""
    keys = [on] if isinstance(on, str) else list(on)
    return runs.join(other.groupBy(*keys).agg(pick(value).alias(value)), keys, "left")


def with_set(rows: DataFrame, other: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """Rows with the sorted different values of another table on a key, joined by commas."""
    return rows.join(other.groupBy(on).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(name)), on, "left")


def match_label(labels: DataFrame, batches: DataFrame, label: str, batch: str) -> DataFrame:
    """Every label with the one batch whose name contains it; a label with none or several is an error.

    Both are lists of a few names, so the pairs are few.
    """
    found = labels.join(batches, F.col(batch).contains(F.col(label)), "left")
    counted = found.groupBy(label).agg(F.count(batch).alias("n"), F.min(batch).alias(batch))
    wrong = F.concat(F.lit("label "), label, F.lit(" stands in "), F.col("n").cast("string"), F.lit(" batches"))
    return counted.select(label, F.when(F.col("n") == 1, F.col(batch)).otherwise(F.raise_error(wrong).cast("string")).alias(batch))


def next_in_run(rows: DataFrame, run: str, order: str, value: str, name: str) -> DataFrame:
    """Each row with the value of the next one of its run: a command and its output."""
    return rows.withColumn(name, F.lead(value).over(Window.partitionBy(run).orderBy(order)))


def arm_ratio(rows: DataFrame, axis: str, arm: str, value: str, control, treatment) -> DataFrame:
    """Mean of the treatment over that of the control for each axis."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    return rows.where(F.col(arm).isin(control, treatment)).groupBy(axis).agg((mean(treatment) / mean(control)).alias("ratio"))


def calls_per_run(calls: DataFrame, run: str, kinds: dict[str, Column]) -> DataFrame:
    """Mean number of calls of each kind in a run."""
    per = calls.groupBy(run).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))
    return per.agg(*(F.avg(n).alias(n) for n in kinds))


def rates(rows: DataFrame, by: str, shares: dict[str, Column]) -> DataFrame:
    """The share of rows of each group for which a condition holds, nulls left out."""
    return rows.groupBy(by).agg(*(F.avg(c.cast("double")).alias(n) for n, c in shares.items()))


def cheapest_arm(rows: DataFrame, instance: str, arm: str, cost: str, least_reps: int = 3) -> DataFrame:
    """The arm of least median cost of each instance among arms with enough repetitions, ties to the first name."""
    medians = rows.groupBy(instance, arm).agg(F.percentile(cost, 0.5).alias("cost"), F.count("*").alias("n")).where(F.col("n") >= least_reps)
    return medians.groupBy(instance).agg(F.min_by(arm, F.struct("cost", arm)).alias("cheapest"), F.min("cost").alias("cost"))


def most_common(rows: DataFrame, item: str, arm: str, arms: Sequence, k: int = 20) -> DataFrame:
    """The k items with most rows, with their number in each arm."""
    per = rows.groupBy(item).agg(*(F.count_if(F.col(arm) == a).alias(str(a)) for a in arms))
    total = sum((F.col(str(a)) for a in arms), F.lit(0))
    return per.orderBy(total.desc(), item).limit(k)


def first_reason(screens: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first screen that a row fails."""
    out = F.lit(kept)
    for name, fails in reversed(screens):
        out = F.when(fails, name).otherwise(out)
    return out


def exclusions(rows: DataFrame, screens: Sequence[tuple[str, Column]]) -> DataFrame:
    return rows.groupBy(first_reason(screens).alias("reason")).agg(F.count("*").alias("n"))


def adoption(calls: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Number of calls of each group and the share that has a flag; a null condition counts as no."""
    return calls.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in flags.items()))


def largest_sibling(rows: DataFrame, repo: str, size: str, name: str) -> DataFrame:
    return rows.groupBy(repo).agg(F.max(size).alias(name))


def resolved_by(rows: DataFrame, instance: str, model: str, resolved: str, models: Sequence) -> DataFrame:
    """Resolved runs of each instance by model, and the rate over all that were scored."""
    per = [F.sum(F.when(F.col(model) == m, F.col(resolved))).cast("long").alias(str(m)) for m in models]
    return rows.groupBy(instance).agg(*per, F.avg(F.col(resolved).cast("double")).alias("rate"))


def patch_files(patch: Column) -> Column:
    """The different files of a unified diff, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+)"), 1))


def patch_stats(patch: Column) -> list[Column]:
    """files, added and removed lines of a unified diff."""
    return [
        F.size(patch_files(patch)).alias("files"), F.regexp_count(patch, F.lit(r"(?m)^\+(?!\+\+)")).alias("added"), F.regexp_count(patch, F.lit(r"(?m)^-(?!--)")).alias("removed"),
    ]


def trajectory_rollup(turns: DataFrame, run: str, role: str, tokens: Column, caller: str = "assistant") -> DataFrame:
    """Turns, summed and greatest tokens, and the caller's turns of each run."""
    return turns.groupBy(run).agg(F.count("*").alias("turns"), F.sum(tokens).alias("tokens"), F.max(tokens).cast("long").alias("peak"), F.count_if(F.col(role) == caller).alias("calls"))


def cost(tokens: DataFrame, kind: str, amount: Column, prices: dict[str, float]) -> DataFrame:
    """Cost of each kind of token; a kind without a price is an error."""
    price = F.raise_error(F.concat(F.lit("no price for "), kind)).cast("double")
    for name, p in prices.items():
        price = F.when(F.col(kind) == name, F.lit(float(p))).otherwise(price)
    sums = tokens.groupBy(kind).agg(F.sum(amount).alias("_amount"))
    return sums.select(kind, (F.col("_amount") * price).alias("cost"))


def affordable_runs(cost_per_run: Column, budget: float) -> Column:
    """How many whole runs a budget pays for."""
    return F.when(cost_per_run > 0, F.floor(F.lit(budget) / cost_per_run))


def pair_change(rows: DataFrame, pair: str, arm: str, value: Column, a, b) -> DataFrame:
    """Percent by which the sum of arm b differs from that of arm a in each pair; null where a has none."""
    total = lambda x: F.sum(F.when(F.col(arm) == x, value)).cast("double")
    got = rows.groupBy(pair).agg(total(a).alias("_a"), total(b).alias("_b"))
    return got.select(pair, F.when(F.col("_a") != 0, (F.col("_b") - F.col("_a")) / F.col("_a") * 100).alias("pct"))


def side_by_side(rows: DataFrame, metric: str, arm: str, value: str, arms: Sequence) -> DataFrame:
    """One row per metric, one column per arm."""
    return rows.groupBy(metric).agg(*(F.max(F.when(F.col(arm) == a, F.col(value))).alias(str(a)) for a in arms))


def dimensions(batches: DataFrame, instances: DataFrame, on: str, by: str, counts: dict[str, Column]) -> DataFrame:
    """Sums over the instances of each batch; instances that the other table lacks count with null."""
    return batches.join(instances, on, "left").groupBy(by).agg(*(c.alias(n) for n, c in counts.items()))


def completeness(rows: DataFrame, by: str, scored: str) -> DataFrame:
    """complete, partial or missing: how many rows of a batch are scored."""
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.count(scored).alias("scored"))
    return per.select(by, "n", "scored", F.when(F.col("scored") == F.col("n"), "complete").when(F.col("scored") == 0, "missing").otherwise("partial").alias("state"))


def starred(pct: Column, p: Column, alpha: float = 0.05) -> Column:
    """A percent with a sign, and a star where it is significant."""
    return F.concat(F.format_string("%+.1f%%", pct), F.when(p < alpha, "*").otherwise(""))


def classified(text: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule whose pattern a text has."""
    return first_reason([(name, text.rlike(pattern)) for name, pattern in rules], other)


def group_breaks(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group: where a printed list changes its heading."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def running_total(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last attempt for each key; one pass with partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def turn_numbers(rows: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """``turn`` from 1 and ``part`` of the run that is over with it."""
    w = Window.partitionBy(run)
    turn = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("turn", turn).withColumn("part", F.col("turn") / F.count("*").over(w))


def first_last_use(rows: DataFrame, run: str, turn: str, used: Column) -> DataFrame:
    """Turn of the first and the last use in each run that has one."""
    return rows.where(used).groupBy(run).agg(F.min(turn).alias("first"), F.max(turn).alias("last"))


def never_after(rows: DataFrame, run: str, order: str, kind: str, first, never) -> DataFrame:
    """Runs in which one kind of call never comes after the first of another."""
    at = rows.groupBy(run).agg(F.min(F.when(F.col(kind) == first, F.col(order))).alias("_a"), F.max(F.when(F.col(kind) == never, F.col(order))).alias("_b"))
    return at.where("_a IS NOT NULL AND (_b IS NULL OR _b < _a)").select(run)


def balanced(rows: DataFrame, bucket: str, order: Sequence[str], k: int) -> DataFrame:
    """k rows, taken from the buckets in turn."""
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("_rn", rn).orderBy("_rn", bucket).limit(k).drop("_rn")


def divided(rows: DataFrame, n: str, total: float, name: str = "part", digits: int = 6) -> DataFrame:
    """n rows of total / n each for every row with n above 0: an action of n sub-calls."""
    each = F.round(F.lit(float(total)) / F.col(n), digits)
    return rows.where(F.col(n) > 0).withColumn(name, F.explode(F.array_repeat(each, F.col(n))))


def required(rows: DataFrame, by: str, item: str, needed: Sequence) -> DataFrame:
    """Whether each group has all needed items, and how many of them."""
    some = F.count_distinct(F.when(F.col(item).isin(*needed), F.col(item)))
    return rows.groupBy(by).agg((some == len(set(needed))).alias("all_there"), some.alias("some"))


def key_union(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns under the union of their names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_summary(rows: DataFrame, path: str) -> None:
    """A CSV with a header, columns in order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def parallelism(rows: DataFrame, by: str, begin: str, end: str) -> DataFrame:
    """Summed durations, wall time and their ratio of each group, in seconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = rows.groupBy(by).agg((F.sum(micros(end) - micros(begin)) / 1e6).alias("busy"), ((F.max(micros(end)) - F.min(micros(begin))) / 1e6).alias("wall"))
    return s.withColumn("parallelism", F.when(F.col("wall") > 0, F.col("busy") / F.col("wall")))
