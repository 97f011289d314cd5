"""Tables of contents, source expansion and file hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symsift.operators.search import FILE, file_filter
from symsift.plans.spec import QuerySpec
from symsift.functions.text import matches_any, span_of
from symsift.schema import TOC_CONTEXTS


def toc_rows(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """Distinct definitions, files and imports of the contexts that a table of contents shows."""
    include, exclude = spec.contexts()
    rows = ci.where(((F.col("is_definition") == 1) | F.col("context").isin("IMP", "FILE")) & F.col("context").isin(*TOC_CONTEXTS))
    if include:
        rows = rows.where(F.col("context").isin(*include))
    if exclude:
        rows = rows.where(~F.col("context").isin(*exclude))
    if spec.files:
        rows = rows.where(file_filter(spec.files))
    if spec.patterns != ("%",):
        rows = rows.where(matches_any("symbol", list(spec.patterns), True))
    start = F.coalesce("span_start", "line")
    return rows.select(*FILE, "context", "full_symbol", start.alias("start_line"), "line", "source_location").distinct()


def toc_counts(rows: DataFrame) -> DataFrame:
    """Rows of each context, imports once per name."""
    return rows.groupBy("context").agg(F.when(F.col("context") == "IMP", F.count_distinct("full_symbol")).otherwise(F.count("*")).alias("n"))


def toc(ci: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row per file: its sections in order of lines, its imports, the column to align on."""
    rows = toc_rows(ci, spec)
    if spec.limit_per_file:
        w = Window.partitionBy(*FILE).orderBy("line", "context", "full_symbol")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= spec.limit_per_file).drop("_n")
    if spec.limit:
        rows = rows.orderBy(*FILE, "line", "context", "full_symbol").limit(spec.limit)
    section = lambda c: F.array_sort(F.collect_list(F.when(F.col("context") == c, F.struct("start_line", "full_symbol")))).alias(c.lower())
    return rows.groupBy(*FILE).agg(
        *(section(c) for c in ("CLASS", "FUNC", "ENUM", "TYPE", "MACRO")),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("context") == "IMP", F.col("full_symbol")))), ", ").alias("imports"),
        F.least(F.lit(40), F.max(F.length("full_symbol"))).alias("align"),
    ).orderBy(*FILE)


def lines_of(docs: DataFrame) -> DataFrame:
    """(directory, filename, line_no, text) of the texts the occurrences come from."""
    return docs.select(
        F.concat(F.lit("./"), "lang", F.lit("/")).alias("directory"), F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), F.posexplode(F.split("text", "\n")).alias("pos", "text")
    ).select("directory", "filename", (F.col("pos") + 1).alias("line_no"), "text")


def expand(rows: DataFrame, lines: DataFrame, before: int = 0, after: int = 0, whole: bool = True) -> DataFrame:
    """The source lines of each row: its span if it is a definition and ``whole``, else its line, with context.

    The needed lines are listed first, so that the join with the text is by
    equality on (file, line) and never scans a file's lines for each row.
    """
    spanned = (F.col("is_definition") == 1) & F.lit(whole) & F.col("span_start").isNotNull()
    a, b = F.when(spanned, F.col("span_start")).otherwise(F.col("line")), F.when(spanned, F.col("span_end")).otherwise(F.col("line"))
    wanted = rows.select(*FILE, "line", "seq", "symbol", F.explode(F.sequence(F.greatest(a - before, F.lit(1)), F.greatest(b + after, F.greatest(a - before, F.lit(1))))).alias("line_no"))
    return wanted.join(lines, [*FILE, "line_no"]).select(*FILE, "seq", "symbol", "line_no", "text").orderBy(*FILE, "seq", "line_no")


def trimmed(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The source of each definition's span, its first and last line cut to the span's columns."""
    at = lambda i: span_of(F.col("source_location"), i)
    a, b = at(1), at(3)
    wanted = rows.where(a.isNotNull()).select(*FILE, "seq", "symbol", a.alias("_a"), at(2).alias("_c"), b.alias("_b"), at(4).alias("_d"), F.explode(F.sequence(a, F.greatest(a, b))).alias("line_no"))
    got = wanted.join(lines, [*FILE, "line_no"])
    end = F.when(F.col("line_no") == F.col("_b"), F.substring("text", F.lit(1), F.col("_d"))).otherwise(F.col("text"))
    cut = F.when(F.col("line_no") == F.col("_a"), F.substring(end, F.col("_c") + 1, F.length(end))).otherwise(end)
    return got.select(*FILE, "seq", "symbol", "line_no", cut.alias("text")).orderBy(*FILE, "seq", "line_no")


def busiest_files(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k files with most rows, and how many files there are besides."""
    per = rows.groupBy(*FILE).agg(F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("_t"))
    return per.orderBy(F.desc("n"), *FILE).limit(k).crossJoin(F.broadcast(total)).select(*FILE, "n", F.greatest(F.lit(0), F.col("_t") - k).alias("others"))  # one row on the other side
