"""Code-quality questions over the occurrence table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["directory", "filename"]


def top(rows: DataFrame, k: int, *ties: str, by: str = "n") -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(k)


def definitions_per_file(ci: DataFrame, k: int = 10) -> DataFrame:
    return top(ci.where("is_definition = 1").groupBy(*FILE).agg(F.count("*").alias("n")), k, *FILE)


def functions_per_file(ci: DataFrame, k: int = 10) -> DataFrame:
    return top(ci.where("is_definition = 1 AND context = 'FUNC'").groupBy(*FILE).agg(F.count("*").alias("n")), k, *FILE)


def hotspots(ci: DataFrame, definitions: int = 50, calls: int = 10) -> DataFrame:
    per = ci.groupBy(*FILE).agg(F.sum("is_definition").cast("long").alias("definitions"), F.count_if(F.col("context") == "CALL").alias("calls"))
    return per.where((F.col("definitions") > definitions) & (F.col("calls") > calls))


def methods_per_class(ci: DataFrame, k: int = 15) -> DataFrame:
    return top(ci.where("context = 'VAR' AND parent_symbol <> ''").groupBy("parent_symbol").agg(F.count("*").alias("n")), k, "parent_symbol")


def arguments_per_function(ci: DataFrame, k: int = 15) -> DataFrame:
    return top(ci.where("context = 'ARG' AND parent_symbol <> ''").groupBy("parent_symbol", *FILE).agg(F.count("*").alias("n")), k, "parent_symbol", *FILE)


def arguments_with_function(ci: DataFrame) -> DataFrame:
    """As-of join: each argument with the nearest function definition at or before its line, by one window."""
    w = Window.partitionBy(*FILE).orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    func = F.when((F.col("context") == "FUNC") & (F.col("is_definition") == 1), F.struct("line", "symbol"))
    rows = ci.where("context = 'ARG' OR context = 'FUNC' AND is_definition = 1").withColumn("owner", F.max(func).over(w))
    return rows.where("context = 'ARG' AND owner IS NOT NULL").select(*FILE, "line", "symbol", "type", "seq", F.col("owner.symbol").alias("function"), F.col("owner.line").alias("function_line"))


def same_type_arguments(ci: DataFrame, least: int = 4) -> DataFrame:
    return arguments_with_function(ci).groupBy(*FILE, "function", "function_line", "type").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def orphans(ci: DataFrame) -> DataFrame:
    """Functions that nothing calls."""
    calls = ci.where("context = 'CALL'").select("symbol").distinct()
    return ci.where("context = 'FUNC' AND is_definition = 1 AND symbol <> 'main'").select("symbol").distinct().join(calls, "symbol", "left_anti")


def fan_in(ci: DataFrame, k: int = 20) -> DataFrame:
    return top(ci.where("is_definition = 0 AND context <> 'COM'").groupBy(F.lower("symbol").alias("symbol")).agg(F.count("*").alias("n")), k, "symbol")


def coupling(ci: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    per = ci.where("context = 'CALL'").groupBy("symbol").agg(F.count_distinct(F.concat("directory", "filename")).alias("n"))
    return top(per.where(F.col("n") > least), k, "symbol")


def mutable_state(ci: DataFrame) -> DataFrame:
    """Static variables with how often their file refers to them."""
    refs = ci.where("is_definition = 0").groupBy(*FILE, "symbol").agg(F.count("*").alias("n"))
    defs = ci.where("context = 'VAR' AND is_definition = 1 AND modifier LIKE '%static%'").select(*FILE, "symbol").distinct()
    return defs.join(refs, [*FILE, "symbol"], "left").select(*FILE, "symbol", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def imports_per_module(cx: DataFrame, k: int = 20) -> DataFrame:
    return top(cx.where("context = 'IMP'").groupBy(*FILE).agg(F.count("*").alias("n")), k, *FILE)


def exports_per_file(ci: DataFrame) -> DataFrame:
    return ci.where("scope = 'public' AND is_definition = 1").groupBy(*FILE).agg(F.count("*").alias("n"))


def shadowing(ci: DataFrame) -> DataFrame:
    """Variables named like a function of their file."""
    funcs = ci.where("context = 'FUNC' AND is_definition = 1").select(*FILE, "symbol").distinct()
    return ci.where("context = 'VAR'").select(*FILE, "symbol").distinct().join(funcs, [*FILE, "symbol"], "left_semi")


def reused_names(ci: DataFrame, k: int = 25) -> DataFrame:
    per = ci.where("context = 'VAR' AND is_definition = 1").groupBy("symbol").agg(F.count_distinct("directory", "filename").alias("n"))
    return top(per, k, "symbol")


def generic_names(ci: DataFrame, names: tuple[str, ...] = ("an", "on", "it", "en", "er", "un")) -> DataFrame:
    return ci.where(F.col("context").isin("VAR", "ARG") & F.col("symbol").isin(*names)).groupBy("symbol").agg(F.count("*").alias("n"))


def naming(ci: DataFrame) -> DataFrame:
    """Functions that begin with a capital, variables that don't, by the displayed name."""
    first = F.substring("full_symbol", 1, 1)
    kind = F.when((F.col("context") == "FUNC") & first.between("A", "Z"), "capital function").when((F.col("context") == "VAR") & first.between("a", "z"), "small variable")
    return ci.where("is_definition = 1").withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def comment_density(ci: DataFrame, least: int = 100) -> DataFrame:
    per = ci.groupBy(*FILE).agg(F.count("*").alias("total"), F.count_if(F.col("context") == "COM").alias("comments")).where(F.col("total") > least)
    return per.select(*FILE, "total", F.round(F.col("comments") / F.col("total"), 3).alias("density"))


def stale_comments(ci: DataFrame, mark: str = "%th%") -> DataFrame:
    """Words of comments that nothing defines."""
    defs = ci.where("is_definition = 1").select("symbol").distinct()
    return ci.where(F.col("context") == "COM").where(F.col("symbol").like(mark)).select("symbol").distinct().join(defs, "symbol", "left_anti")
