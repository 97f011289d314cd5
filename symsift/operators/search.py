"""Searches over the occurrence table: filters, co-occurrence, containment, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symsift.functions.text import any_of, contains_value, file_pattern, fold, matches, matches_any, pattern_tokens
from symsift.plans.spec import QuerySpec, default_columns
from symsift.schema import ORDER

FILE = ["directory", "filename"]
LINE = [*FILE, "line"]


def file_filter(files: tuple[str, ...]) -> Column:
    parts = []
    for f in files:
        directory, name = file_pattern(f)
        c = matches("filename", name)
        parts.append(matches("directory", directory) & c if directory else c)
    return any_of(parts)


def filters(spec: QuerySpec) -> dict[str, Column]:
    """Row filters by the name of what asks for them, without the patterns and the joins."""
    include, exclude = spec.contexts()
    out: dict[str, Column] = {}
    if include:
        out["include"] = F.col("context").isin(*include)
    if exclude:
        out["exclude"] = ~F.col("context").isin(*exclude)
    if spec.files:
        out["files"] = file_filter(spec.files)
    for name, values in spec.meta.items():
        if values:
            out[name] = any_of([contains_value(name, v) for v in values])
    if len(spec.definition) == 1:
        out["definition"] = F.col("is_definition") == spec.definition[0]
    if spec.lines:
        out["lines"] = F.col("line").between(*spec.lines)
    return out


def filtered(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows that pass every filter but the patterns."""
    for c in filters(spec).values():
        ci = ci.where(c)
    return ci


def parent_typed(rows: DataFrame, ci: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows whose parent is defined in the same file as a variable, argument or property of a type.

    The definition's symbol is folded and the parent is compared as it is, so a
    parent in mixed case finds none.
    """
    defs = ci.where((F.col("is_definition") == 1) & F.col("context").isin("VAR", "ARG", "PROP") & matches_any("type", list(types)))
    keys = defs.select(F.col("directory").alias("_d"), F.col("filename").alias("_f"), F.col("symbol").alias("_s"))
    at = (F.col("directory") == F.col("_d")) & (F.col("filename") == F.col("_f")) & (F.col("parent_symbol") == F.col("_s"))
    return rows.where("parent_symbol <> ''").join(keys, at, "left_semi")


def spans_of(ci: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(directory, filename, span_start, span_end) of the definitions with those exact names."""
    found = ci.where((F.col("is_definition") == 1) & F.col("symbol").isin(*map(fold, names)) & F.col("span_start").isNotNull())
    return found.select(*FILE, "span_start", "span_end").distinct()


def merged_spans(spans: DataFrame) -> DataFrame:
    """Spans of a file that overlap or touch, as one."""
    order = Window.partitionBy(*FILE).orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("span_start") > reach + 1), 1).otherwise(0)
    run = spans.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    return run.groupBy(*FILE, "_run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_run")


def inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows whose line is inside any of the spans of their file; co-partitioned by file, never broadcast by hint."""
    s = merged_spans(spans).select(F.col("directory").alias("_d"), F.col("filename").alias("_f"), F.col("span_start").alias("_a"), F.col("span_end").alias("_b"))
    return rows.join(s, (F.col("directory") == F.col("_d")) & (F.col("filename") == F.col("_f")) & F.col("line").between(F.col("_a"), F.col("_b")), "left_semi")


def missing_definitions(ci: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Names among ``names`` that no definition has; the list is as long as the command at most."""
    found = {r["symbol"] for r in ci.where((F.col("is_definition") == 1) & F.col("symbol").isin(*map(fold, names)) & F.col("span_start").isNotNull()).select("symbol").distinct().collect()}
    return [n for n in names if fold(n) not in found]


def pattern_ids(patterns: tuple[str, ...]) -> Column:
    """The numbers of the patterns that a row's symbol matches."""
    return F.array_compact(F.array(*(F.when(matches("symbol", p, True), F.lit(i)) for i, p in enumerate(patterns))))


def matched(rows: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Rows that match any pattern, with the numbers of those they match as _p; arrays are made for no others."""
    return rows.where(matches_any("symbol", list(patterns), True)).withColumn("_p", pattern_ids(patterns))


def difference(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct symbols of rows that the others don't have; both sides are reduced before anything is joined."""
    return rows.select("symbol").distinct().join(others.select("symbol").distinct(), "symbol", "left_anti")


def same_line(base: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Rows of lines on which every pattern occurs: one shuffle on the line's key instead of a join per pattern."""
    hit = matched(base, patterns)
    lines = hit.groupBy(*LINE).agg(F.array_distinct(F.flatten(F.collect_set("_p"))).alias("_all")).where(F.size("_all") == len(patterns)).select(*LINE)
    return hit.join(lines, LINE, "left_semi").drop("_p")


def proximity(ci: DataFrame, base: DataFrame, patterns: tuple[str, ...], reach: int, mode: str = "set") -> DataFrame:
    """Rows near each other.

    native: for every row of the first pattern that has a filtered row of each
    other pattern within ``reach`` lines, all rows of the first pattern on its
    line (unfiltered) and those other rows; overlapping anchors repeat rows.
    set: the same rows, filtered and once each.  web: rows of any pattern that
    have a row of every pattern within ``reach`` lines of themselves.

    The band join works on buckets of 2 * reach + 1 lines: each row lies in one
    bucket and each anchor looks into the two its band can touch, so a huge
    file is many keys, not one.
    """
    width = 2 * reach + 1
    hit = matched(base, patterns)
    if mode == "web":
        marks = hit.select(*FILE, F.col("line").alias("_l"), F.explode("_p").alias("_q")).distinct().withColumn("_b", F.floor(F.col("_l") / width))
        lines = hit.select(*LINE).distinct()
        probe = lines.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - reach) / width), F.floor((F.col("line") + reach) / width)))))
        near = probe.join(marks, [*FILE, "_b"]).where(F.abs(F.col("_l") - F.col("line")) <= reach)
        good = near.groupBy(*LINE).agg(F.count_distinct("_q").alias("_n")).where(F.col("_n") == len(patterns)).select(*LINE)
        return hit.join(good, LINE, "left_semi").drop("_p")
    buckets = lambda at: F.explode(F.array_distinct(F.array(F.floor((at - reach) / width), F.floor((at + reach) / width))))
    anchors = base.where(matches("symbol", patterns[0], True)).select(*FILE, F.col("line").alias("_a"))
    others = hit.where(F.exists("_p", lambda x: x > 0)).withColumn("_b", F.floor(F.col("line") / width))
    marks = others.select(*FILE, "_b", F.col("line").alias("_l"), F.explode("_p").alias("_q")).where("_q > 0").distinct()  # lines, not rows
    lines = anchors.distinct().withColumn("_b", buckets(F.col("_a")))
    near = lines.join(marks, [*FILE, "_b"]).where(F.abs(F.col("_l") - F.col("_a")) <= reach)
    counted = near.groupBy(*FILE, "_a").agg(F.count_distinct("_q").alias("_n"))
    good = counted.where(F.col("_n") == len(patterns) - 1).select(*FILE, "_a")
    source = ci if mode == "native" else base
    first = source.where(matches("symbol", patterns[0], True))
    if mode == "native":  # once for each anchor row, of each anchor line
        bands = anchors.join(good, [*FILE, "_a"], "left_semi")
        on_line = first.join(bands.withColumnRenamed("_a", "line"), LINE)
        again = bands.withColumn("_b", buckets(F.col("_a"))).join(others, [*FILE, "_b"]).where(F.abs(F.col("line") - F.col("_a")) <= reach)
        second = again.select(*base.columns, F.explode(F.filter("_p", lambda x: x > 0)).alias("_q")).drop("_q")
        return on_line.select(*base.columns).unionAll(second)
    bands = good.select(F.col("directory").alias("_d"), F.col("filename").alias("_f"), "_a", buckets(F.col("_a")).alias("_k"))
    at = (F.col("directory") == F.col("_d")) & (F.col("filename") == F.col("_f")) & (F.col("_b") == F.col("_k")) & (F.abs(F.col("line") - F.col("_a")) <= reach)
    second = others.join(bands, at, "left_semi").select(*base.columns)
    both = first.join(good.withColumnRenamed("_a", "line"), LINE, "left_semi").select(*base.columns).unionAll(second)
    return both.dropDuplicates([*LINE, "seq"])  # seq tells the rows of one file apart


def select_rows(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """All rows a spec asks for, before limits and projection."""
    base = filtered(ci, spec)
    if spec.parent_type:
        base = parent_typed(base, ci, spec.parent_type)
    if spec.within:
        base = inside(base, spans_of(ci, spec.within))
    if spec.together is not None and len(spec.patterns) > 1:
        if spec.together == 0:
            return same_line(base, spec.patterns)
        return proximity(ci, base, spec.patterns, spec.together, spec.mode)
    return base.where(matches_any("symbol", list(spec.patterns), True))


def limited(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """The first rows of each file, then the first rows, in order."""
    if spec.limit_per_file:
        number = F.row_number().over(Window.partitionBy(*FILE).orderBy("line", "seq"))
        rows = rows.withColumn("_n", number).where(F.col("_n") <= spec.limit_per_file).drop("_n")
    rows = rows.orderBy(*ORDER)
    return rows.limit(spec.limit) if spec.limit else rows


def search(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows in order, with directory and filename before the projected columns."""
    rows = limited(select_rows(ci, spec), spec)
    wanted = [c for c in default_columns(spec) if c not in FILE]
    return rows.select(*FILE, *wanted)


def files(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """The distinct files of a result."""
    rows = select_rows(ci, spec).select(*FILE).distinct().orderBy(*FILE)
    return rows.limit(spec.limit) if spec.limit else rows


def breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("context").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context")


def count_files(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("directory", "filename").alias("files"))


def widths(rows: DataFrame, columns: list[str], limit: int = 0) -> DataFrame:
    """The longest value of each column, of the first rows if there is a limit."""
    if limit:
        rows = rows.orderBy(*ORDER).limit(limit)
    return rows.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns))


def summary(ci: DataFrame) -> DataFrame:
    return ci.agg(
        F.count("*").alias("total"), F.count_distinct("directory", "filename").alias("files"), F.count_distinct("symbol").alias("symbols"),
        F.sum("is_definition").cast("long").alias("definitions"),
    )


def diagnose(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """One pass: how many rows would be left with each filter cleared, and with all.

    filter, n: ``none`` is the count as asked, ``all`` without any filter.
    """
    parts = filters(spec)
    hit = ci.where(matches_any("symbol", list(spec.patterns), True))
    and_ = lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))
    probes = {"none": and_(parts.values()), "all": F.lit(True)} | {n: and_(c for m, c in parts.items() if m != n) for n in parts}
    one = hit.agg(*(F.count_if(c).alias(n) for n, c in probes.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in probes))).alias("x")).select("x.*")


def culprits(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """The filters without which rows would be found, by how many."""
    return diagnose(ci, spec).where("filter NOT IN ('none', 'all') AND n > 0").orderBy(F.desc("n"), "filter")


def recover(ci: DataFrame, spec: QuerySpec) -> tuple[QuerySpec, str | None]:
    """What to search for instead when nothing was found: a qualified name, or the pattern as a part of symbols."""
    from dataclasses import replace

    tries = []
    if spec.qualified:
        head, tail = spec.qualified
        tries += [(replace(spec, patterns=(tail,), meta=spec.meta | {c: (head,)}, qualified=None), f"{tail} with {c} {head}") for c in ("parent_symbol", "namespace")]
    plain = [p for p in spec.patterns if ("%", True) not in pattern_tokens(p)]
    if len(spec.patterns) == 1 and plain:
        tries.append((replace(spec, patterns=(f"%{spec.patterns[0]}%",), qualified=None), f"symbols that contain {spec.patterns[0]}"))
    for other, why in tries:
        if select_rows(ci, other).limit(1).count():
            return other, why
    return spec, None
