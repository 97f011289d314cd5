"""The occurrence table built from ``documents``, stored once and read by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symsift.functions.text import CLEAN, STOPWORDS, clean_word
from symsift.schema import STORED
from symsift.storage import scratch

_built: dict[tuple[str, str], str] = {}


_KEPT = CLEAN[:-2] + " -]"  # spaces stay as well, so that a line is cleaned at once
_fits = lambda c: (F.length(c) >= 2) & ~F.lower(c).isin(*STOPWORDS)
_key = lambda c: F.rtrim(F.lower(c), F.lit(".,!?:;"))  # noqa: E731  search_key of a cleaned word, which is ASCII


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, last, line, x): outer, as Spark would else split once more to test for emptiness."""
    xs = docs.select("doc_id", "lang", "source", F.split("text", "\n").alias("xs")).select("*", F.size("xs").alias("last"))
    lines = xs.select("doc_id", "lang", "source", "last", F.concat(F.lit("./"), "lang", F.lit("/")).alias("directory"), F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), F.posexplode_outer("xs").alias("pos", "x"))
    return lines.withColumn("line", F.col("pos") + 1)


def _rows(w: DataFrame) -> DataFrame:
    """The table's columns of words that have their line, number, context, head and stop."""
    is_any = lambda *c: F.col("context").isin(*c)
    w, stop = w.withColumn("symbol", _key(F.col("full_symbol"))), F.col("stop")
    return w.select(
        "symbol", "directory", "filename", F.col("line").cast("int").alias("line"), "context", "full_symbol",
        F.when(stop.isNotNull(), F.concat("line", F.lit(":0 - "), stop, F.lit(":0"))).otherwise("").alias("source_location"),
        F.when(is_any("ARG", "CALL", "VAR"), F.col("head")).otherwise("").alias("parent_symbol"),
        F.when(F.substring("full_symbol", 1, 1).between("A", "Z"), "public").otherwise("private").alias("scope"), F.col("lang").alias("namespace"),
        F.when(F.length("symbol") >= 10, "static").otherwise("").alias("modifier"), F.when(is_any("ARG"), F.col("head")).otherwise("").alias("clue"),
        F.when(is_any("ARG", "VAR"), F.concat(F.lit("t"), F.length("symbol") % 5)).otherwise("").alias("type"),
        F.when(is_any("CLASS", "FUNC", "VAR"), 1).otherwise(0).alias("is_definition"),
        (F.col("line").cast("long") * 1_000_000_000 + F.col("w")).alias("seq"),
        F.when(stop.isNotNull(), F.col("line")).cast("int").alias("span_start"), stop.cast("int").alias("span_end"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Words as occurrences: words of classes and all others are made apart.

    What a line decides (its head word, its cleaned words) is computed before
    words are exploded, so the others need no join, shuffle or sort.  Only the
    words that open a class are shuffled, to find where the next one begins.
    """
    lines = _lines(docs)
    # any run of white space as one space, so that words and cleaned words are split alike
    lines = lines.withColumn("x", F.regexp_replace(F.trim("x"), r"\s{2,}|[^\S ]", " "))
    words = lines.select("*", F.split("x", " ").alias("words"), F.split(F.regexp_replace("x", _KEPT, ""), " ").alias("clean"))
    first = F.col("clean")[0]
    words = words.select("directory", "filename", "lang", "line", "words", "clean", F.size("words").alias("n"), F.when(_fits(first), _key(first)).otherwise("").alias("head"))
    w = words.select("directory", "filename", "lang", "line", "n", "clean", "head", F.posexplode_outer("words").alias("at", "raw")).withColumn("w", F.col("at") + 1)
    w = w.where("raw != ''").withColumn("full_symbol", F.get("clean", F.col("at"))).where(_fits(F.col("full_symbol")) & ~((F.col("n") <= 3) & (F.col("w") == 1)))
    context = F.when(F.col("w") == 1, "FUNC").when(F.col("raw").endswith(","), "ARG").when(F.col("raw").endswith("."), "CALL").when(F.col("w") % 2 == 0, "VAR").otherwise("COM")
    others = w.withColumn("context", context).withColumn("stop", F.when(F.col("w") == 1, F.col("line")))
    return _rows(others).unionAll(_rows(_classes(docs)))


def _classes(docs: DataFrame) -> DataFrame:
    """First words of lines of three words at most; a class ends before the document's next one.

    The least line after each is a running minimum from the end, in one pass.
    """
    short = F.split(F.trim("x"), r"\s+", 4)
    c = _lines(docs).where(F.size(short) <= 3).select("doc_id", "lang", "source", "last", "line", clean_word(short[0]).alias("full_symbol")).where(_fits(F.col("full_symbol")))
    later = Window.partitionBy("doc_id").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("stop", F.coalesce(F.min("line").over(later) - 1, F.col("last")))
    return c.select(
        F.concat(F.lit("./"), "lang", F.lit("/")).alias("directory"), F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"),
        "lang", "line", "full_symbol", F.lit("CLASS").alias("context"), F.lit("").alias("head"), F.lit(1).alias("w"), "stop",
    )


def with_files(ci: DataFrame) -> DataFrame:
    """The table with one FILE row per file and the last long word of long lines as IMP, for tables of contents."""
    base = [n for n, _ in STORED]
    file = ci.groupBy("directory", "filename").agg(F.min("seq").alias("seq")).select(
        F.lower(F.regexp_replace("filename", r"\.txt$", "")).alias("symbol"), "directory", "filename", F.lit(1).alias("line"), F.lit("FILE").alias("context"),
        F.regexp_replace("filename", r"\.txt$", "").alias("full_symbol"), *(F.lit("").alias(c) for c in ("source_location", "parent_symbol", "scope", "namespace", "modifier", "clue", "type")),
        F.lit(0).alias("is_definition"), (F.col("seq") - 1).alias("seq"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"),
    )
    imp = ci.where("context = 'CALL' AND length(symbol) >= 8").withColumn("context", F.lit("IMP")).select(*base)
    return ci.select(*base).unionByName(file.select(*base)).unionByName(imp)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of a folder of tables; the first call of a session builds it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = scratch(spark, "occurrences")
        rows = from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
        rows.write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


_CLEAN = r"[^A-Za-z0-9_./:@#?&=+^$!~<>\[\]%-]"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: The same table in SQL, as a list of common table expressions that ends in ci.
SQL = rf"""
l AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS xs FROM documents),
l2 AS (SELECT doc_id, lang, source, len(xs) AS last, unnest(xs) AS x, generate_subscripts(xs, 1) AS line FROM l),
w0 AS (SELECT doc_id, lang, source, last, line, regexp_split_to_array(trim(x), '\s+') AS ws FROM l2),
w1 AS (SELECT doc_id, lang, source, last, line, len(ws) AS n, unnest(ws) AS raw, generate_subscripts(ws, 1) AS w FROM w0),
w2 AS (SELECT *, regexp_replace(raw, '{_CLEAN}', '', 'g') AS full_symbol FROM w1 WHERE raw <> ''),
w3 AS (SELECT *, regexp_replace(lower(full_symbol), '[.,!?:;]+$', '') AS symbol,
         CASE WHEN n <= 3 AND w = 1 THEN 'CLASS' WHEN w = 1 THEN 'FUNC' WHEN raw LIKE '%,' THEN 'ARG' WHEN raw LIKE '%.' THEN 'CALL' WHEN w % 2 = 0 THEN 'VAR' ELSE 'COM' END AS context
       FROM w2 WHERE length(full_symbol) >= 2 AND lower(full_symbol) NOT IN ({_STOP})),
heads AS (SELECT doc_id, line, min(symbol) AS head FROM w3 WHERE w = 1 GROUP BY ALL),
ends AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS stop FROM (SELECT DISTINCT doc_id, line FROM w3 WHERE context = 'CLASS')),
ci AS (SELECT symbol, './' || lang || '/' AS directory, source || '_' || doc_id || '.txt' AS filename, CAST(line AS INTEGER) AS line, context, full_symbol,
         CASE WHEN context = 'CLASS' THEN line || ':0 - ' || coalesce(stop, last) || ':0' WHEN context = 'FUNC' THEN line || ':0 - ' || line || ':0' ELSE '' END AS source_location,
         CASE WHEN context IN ('ARG', 'CALL', 'VAR') THEN coalesce(head, '') ELSE '' END AS parent_symbol,
         CASE WHEN full_symbol[1] BETWEEN 'A' AND 'Z' THEN 'public' ELSE 'private' END AS scope, lang AS namespace, CASE WHEN length(symbol) >= 10 THEN 'static' ELSE '' END AS modifier,
         CASE WHEN context = 'ARG' THEN coalesce(head, '') ELSE '' END AS clue, CASE WHEN context IN ('ARG', 'VAR') THEN 't' || (length(symbol) % 5) ELSE '' END AS type,
         CASE WHEN context IN ('CLASS', 'FUNC', 'VAR') THEN 1 ELSE 0 END AS is_definition, CAST(line AS BIGINT) * 1000000000 + w AS seq,
         CAST(CASE WHEN context IN ('CLASS', 'FUNC') THEN line END AS INTEGER) AS span_start,
         CAST(CASE WHEN context = 'CLASS' THEN coalesce(stop, last) WHEN context = 'FUNC' THEN line END AS INTEGER) AS span_end
       FROM w3 LEFT JOIN heads USING (doc_id, line) LEFT JOIN ends USING (doc_id, line))"""
SQL_FILES = r"""
cx AS (SELECT * FROM ci
       UNION ALL SELECT lower(regexp_replace(filename, '\.txt$', '')), directory, filename, 1, 'FILE', regexp_replace(filename, '\.txt$', ''), '', '', '', '', '', '', '', 0, min(seq) - 1, NULL, NULL FROM ci GROUP BY directory, filename
       UNION ALL SELECT * REPLACE ('IMP' AS context) FROM ci WHERE context = 'CALL' AND length(symbol) >= 8)"""
