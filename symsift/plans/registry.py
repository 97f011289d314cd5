"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symsift.functions import commands as K
from symsift.functions import text as X
from symsift.operators import recipes as R
from symsift.operators import runs as E
from symsift.operators import search as S
from symsift.operators import stats as A
from symsift.operators import toc as C
from symsift.plans.spec import QuerySpec, parse_command
from symsift.sources.occurrences import SQL, SQL_FILES, from_documents, occurrences, with_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROW = "directory, filename, line, symbol, context, seq"
FILE = "directory, filename"
COLS = ["directory", "filename", "line", "symbol", "context", "seq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_index(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the occurrence table; its SQL sees it as ci."""
    QUERIES[name] = lambda spark, sf_dir: build(occurrences(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {SQL}\n{sql}"


def on_files(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the table with FILE and IMP rows; its SQL sees it as cx."""
    QUERIES[name] = lambda spark, sf_dir: build(with_files(occurrences(spark, sf_dir)))
    if sql:
        ORACLES[name] = f"WITH {SQL},{SQL_FILES}\n{sql}"


def on_tables(name: str, build: Callable[..., DataFrame], sql: str | None, *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(*(table(spark, sf_dir, t) for t in tables))
    if sql:
        ORACLES[name] = sql


def rows(command: str, **more) -> Callable[[DataFrame], DataFrame]:
    from dataclasses import replace

    spec = replace(parse_command(command), **more)
    return lambda ci: S.select_rows(ci, spec).select(*COLS)


# flagship
QUERIES["entry_prefix_search"] = lambda spark, sf_dir: S.search(occurrences(spark, sf_dir), parse_command("th% -i func class -lpf 2"))
ORACLES["entry_prefix_search"] = f"""WITH {SQL} SELECT {FILE}, line, symbol, context FROM (
    SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY line, seq) AS n FROM ci WHERE symbol LIKE 'th%' AND context IN ('FUNC', 'CLASS')) WHERE n <= 2"""

# the table itself
on_index("s1_index_scan", lambda ci: ci.select(*[c for c in ci.columns if c not in ("span_start", "span_end")]), "SELECT * EXCLUDE (span_start, span_end) FROM ci")
QUERIES["s2_index_build"] = lambda spark, sf_dir: from_documents(table(spark, sf_dir, "documents")).groupBy("context").agg(F.count("*").alias("n"), F.sum("line").cast("long").alias("lines"), F.sum("seq").cast("decimal(38,0)").cast("string").alias("seqs"))
ORACLES["s2_index_build"] = f"WITH {SQL} SELECT context, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(seq) AS VARCHAR) AS seqs FROM ci GROUP BY context"

# patterns and filters
W = f"SELECT {ROW} FROM ci WHERE"
on_index("m1_wildcards", rows("th*n"), f"{W} symbol LIKE 'th%n'")
on_index("m2_alternation", rows("'the|oner*'"), f"{W} symbol = 'the' OR symbol LIKE 'oner%'")
on_index("m5_qualified_name", lambda ci: S.select_rows(ci, QuerySpec(patterns=("the%",), meta={"parent_symbol": ("an",)})).select(*COLS), f"{W} symbol LIKE 'the%' AND parent_symbol LIKE '%an%'")
on_index("m6_like", rows("e_"), f"{W} symbol LIKE 'e_'")
on_index("m6_like_escape", rows(r"'\%an*' 'an\_*' th."), f"{W} symbol LIKE 'an!_%' ESCAPE '!' OR symbol LIKE '!%an%' ESCAPE '!' OR symbol LIKE 'th_'")
on_index("m7_ascii_fold", lambda ci: ci.where(X.matches("full_symbol", "THE*")).select(*COLS), f"{W} translate(full_symbol, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'the%'")
on_index("p1_pattern_or", rows("an en er st%"), f"{W} symbol IN ('an', 'en', 'er') OR symbol LIKE 'st%'")
on_index("p2_context_include", rows("in% -i func var"), f"{W} symbol LIKE 'in%' AND context IN ('FUNC', 'VAR')")
on_index("p3_context_exclude", rows("in% -x noise call"), f"{W} symbol LIKE 'in%' AND context NOT IN ('COM', 'STR', 'CALL')")
on_index("p3_include_beats_exclude", rows("in% -i func -x func"), f"{W} symbol LIKE 'in%' AND context = 'FUNC'")
on_index("p4_metadata", rows("% -p ther -t t1 t2 -m stat"), f"{W} parent_symbol LIKE '%ther%' AND (type LIKE '%t1%' OR type LIKE '%t2%') AND modifier LIKE '%stat%'")
on_index("p4_scope_namespace", rows("on% -s pub -ns en"), f"{W} symbol LIKE 'on%' AND scope LIKE '%pub%' AND namespace LIKE '%en%'")
on_index("p5_definitions", rows("re% --def"), f"{W} symbol LIKE 're%' AND is_definition = 1")
on_index("p5_usages", rows("re% --usage"), f"{W} symbol LIKE 're%' AND is_definition = 0")
on_index("p6_file_filter", rows("an% -f en/src1_% .md src2_1%"), f"{W} symbol LIKE 'an%' AND (directory LIKE '%/en/' AND filename LIKE 'src1!_%' ESCAPE '!' OR directory LIKE '%/en/' AND filename LIKE 'src1_%' OR filename LIKE '%.md' OR filename LIKE 'src2_1%')")
on_index("p7_file_pattern", rows("an% -f ./en/src3*"), f"{W} symbol LIKE 'an%' AND directory LIKE '%_/en/' AND filename LIKE 'src3%'")
on_index("p8_lines", rows("th% --lines 2-4"), f"{W} symbol LIKE 'th%' AND line BETWEEN 2 AND 4")
on_index("p9_within_and_filters", rows("th% --within and -i var"), f"{W} symbol LIKE 'th%' AND context = 'VAR' AND EXISTS (SELECT 1 FROM ci d WHERE d.symbol = 'and' AND d.is_definition = 1 AND d.span_start IS NOT NULL AND d.directory = ci.directory AND d.filename = ci.filename AND ci.line BETWEEN d.span_start AND d.span_end)")
on_index("p11_projection", lambda ci: S.search(ci, parse_command("oner% -p -t t1 --limit 50")), f"SELECT {FILE}, line, symbol, parent_symbol, type, context FROM ci WHERE symbol LIKE 'oner%' AND type LIKE '%t1%' ORDER BY {FILE}, line, seq LIMIT 50")
on_index("p12_context_names", lambda ci: ci.groupBy(F.create_map(*(F.lit(x) for kv in {"CLASS": "CLASS", "FUNC": "FUNCTION", "ARG": "ARGUMENT", "VAR": "VARIABLE", "COM": "COMMENT", "CALL": "CALL"}.items() for x in kv))[F.col("context")].alias("name")).agg(F.count("*").alias("n")), "SELECT CASE context WHEN 'FUNC' THEN 'FUNCTION' WHEN 'ARG' THEN 'ARGUMENT' WHEN 'VAR' THEN 'VARIABLE' WHEN 'COM' THEN 'COMMENT' ELSE context END AS name, count(*) AS n FROM ci GROUP BY 1")
on_index("p13_paths", lambda ci: ci.select(F.concat("directory", "filename").alias("path")).distinct(), "SELECT DISTINCT directory || filename AS path FROM ci")
on_index("p15_spans", lambda ci: ci.where("source_location <> ''").select("seq", X.span_of(F.col("source_location"), 1).alias("a"), X.span_of(F.col("source_location"), 3).alias("b")), r"SELECT seq, CAST(regexp_extract(source_location, '^(\d+):', 1) AS INTEGER) AS a, CAST(regexp_extract(source_location, '- (\d+):', 1) AS INTEGER) AS b FROM ci WHERE source_location <> ''")

# joins
_BOTH = "SELECT directory, filename, line, symbol, context, seq FROM (SELECT *, {} FROM (SELECT *, {} FROM ci) WHERE {}) WHERE {}"


def _on_line(tests: dict[str, str], where: str = "true") -> str:
    """Rows of lines on which every test holds for some row: one pass."""
    hits = ", ".join(f"{t} AND {where} AS {n}" for n, t in tests.items())
    over = ", ".join(f"bool_or({n}) OVER (PARTITION BY directory, filename, line) AS all_{n}" for n in tests)
    return _BOTH.format(over, hits, " OR ".join(tests), " AND ".join(f"all_{n}" for n in tests))


on_index("j1_same_line", rows("an% th% --and"), _on_line({"a": "symbol LIKE 'an%'", "b": "symbol LIKE 'th%'"}))
on_index("j1_same_line_three", rows("an% th% re% --and -x com"), _on_line({"a": "symbol LIKE 'an%'", "b": "symbol LIKE 'th%'", "c": "symbol LIKE 're%'"}, "context <> 'COM'"))
QUERIES["j2_parent_type"] = lambda spark, sf_dir: rows("% --parent-type t2")(occurrences(spark, sf_dir))
ORACLES["j2_parent_type"] = f"WITH {SQL.replace('ci AS (', 'ci AS MATERIALIZED (')}, d AS (SELECT DISTINCT {FILE}, symbol AS parent_symbol FROM ci WHERE is_definition = 1 AND context IN ('VAR', 'ARG', 'PROP') AND type LIKE 't2') SELECT {ROW} FROM ci SEMI JOIN d USING ({FILE}, parent_symbol) WHERE parent_symbol <> ''"
on_index("j3_within", lambda ci: S.inside(ci, S.spans_of(ci.where("context = 'CLASS' AND symbol LIKE 'a%'").withColumn("symbol", F.lit("a")), ("a",))).select(*COLS), f"{W} EXISTS (SELECT 1 FROM ci d WHERE d.context = 'CLASS' AND d.symbol LIKE 'a%' AND d.directory = ci.directory AND d.filename = ci.filename AND ci.line BETWEEN d.span_start AND d.span_end)")
_NEAR = "b.directory = a.directory AND b.filename = a.filename AND b.line BETWEEN greatest(1, a.line - 2) AND a.line + 2"
_GOOD = f"good AS (SELECT * FROM ci a WHERE a.symbol LIKE 'oner%' AND EXISTS (SELECT 1 FROM ci b WHERE {_NEAR} AND b.symbol LIKE 'ther%'))"
on_index("j4_proximity_native", rows("oner% ther% --and 2", mode="native"), f", {_GOOD} SELECT a2.directory, a2.filename, a2.line, a2.symbol, a2.context, a2.seq FROM good a JOIN ci a2 ON a2.directory = a.directory AND a2.filename = a.filename AND a2.line = a.line AND a2.symbol LIKE 'oner%' UNION ALL SELECT b.directory, b.filename, b.line, b.symbol, b.context, b.seq FROM good a JOIN ci b ON {_NEAR} AND b.symbol LIKE 'ther%'")
on_index("j4_proximity_set", rows("oner% ther% --and 2"), f", {_GOOD} SELECT a2.directory, a2.filename, a2.line, a2.symbol, a2.context, a2.seq FROM good a JOIN ci a2 ON a2.directory = a.directory AND a2.filename = a.filename AND a2.line = a.line AND a2.symbol LIKE 'oner%' UNION SELECT b.directory, b.filename, b.line, b.symbol, b.context, b.seq FROM good a JOIN ci b ON {_NEAR} AND b.symbol LIKE 'ther%'")
_WEB = "EXISTS (SELECT 1 FROM ci b WHERE b.directory = ci.directory AND b.filename = ci.filename AND b.symbol LIKE '{}' AND abs(b.line - ci.line) <= 2)"
on_index("j5_proximity_web", rows("oner% ther% --and 2", mode="web"), f"{W} (symbol LIKE 'oner%' OR symbol LIKE 'ther%') AND {_WEB.format('oner%')} AND {_WEB.format('ther%')}")
on_index("j6_proximity_filtered", rows("oner% ther% anre% --and 5 -x com"), f", f AS (SELECT * FROM ci WHERE context <> 'COM'), good AS (SELECT * FROM f a WHERE a.symbol LIKE 'oner%' AND EXISTS (SELECT 1 FROM f b WHERE b.directory = a.directory AND b.filename = a.filename AND abs(b.line - a.line) <= 5 AND b.symbol LIKE 'ther%') AND EXISTS (SELECT 1 FROM f b WHERE b.directory = a.directory AND b.filename = a.filename AND abs(b.line - a.line) <= 5 AND b.symbol LIKE 'anre%')) SELECT {ROW} FROM good UNION SELECT b.directory, b.filename, b.line, b.symbol, b.context, b.seq FROM good a JOIN f b ON b.directory = a.directory AND b.filename = a.filename AND abs(b.line - a.line) <= 5 AND (b.symbol LIKE 'ther%' OR b.symbol LIKE 'anre%')")
for _n in ("j4_proximity_native", "j4_proximity_set", "j6_proximity_filtered"):  # their SQL goes on with the list of tables
    ORACLES[_n] = ORACLES[_n].replace("\n, ", ",\n", 1)
on_index("j7_orphans", R.orphans, "SELECT DISTINCT symbol FROM ci f WHERE context = 'FUNC' AND is_definition = 1 AND symbol <> 'main' AND NOT EXISTS (SELECT 1 FROM ci c WHERE c.context = 'CALL' AND c.symbol = f.symbol)")
on_index("j8_shadowing", R.shadowing, f"SELECT DISTINCT {FILE}, symbol FROM ci v WHERE context = 'VAR' AND EXISTS (SELECT 1 FROM ci f WHERE f.context = 'FUNC' AND f.is_definition = 1 AND f.symbol = v.symbol AND f.directory = v.directory AND f.filename = v.filename)")
on_index("j9_stale_comments", R.stale_comments, "SELECT DISTINCT symbol FROM ci c WHERE context = 'COM' AND symbol LIKE '%th%' AND NOT EXISTS (SELECT 1 FROM ci d WHERE d.is_definition = 1 AND d.symbol = c.symbol)")
on_index("j10_mutable_state", R.mutable_state, f"SELECT d.directory, d.filename, d.symbol, count(r.seq) AS n FROM (SELECT DISTINCT {FILE}, symbol FROM ci WHERE context = 'VAR' AND is_definition = 1 AND modifier LIKE '%static%') d LEFT JOIN ci r ON r.directory = d.directory AND r.filename = d.filename AND r.symbol = d.symbol AND r.is_definition = 0 GROUP BY ALL")
on_index("j11_asof_function", lambda ci: R.arguments_with_function(ci).select("seq", "function_line"), f"SELECT a.seq, f.line AS function_line FROM (SELECT * FROM ci WHERE context = 'ARG') a ASOF JOIN (SELECT DISTINCT {FILE}, line FROM ci WHERE context = 'FUNC' AND is_definition = 1) f ON a.directory = f.directory AND a.filename = f.filename AND a.line >= f.line")
on_tables("j12_left_join_default", lambda d, l: E.with_evaluation(d, l, "doc_id", "quality").select("doc_id", "outcome", "success"), "SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_evaluated' WHEN quality = 1 THEN 'resolved' ELSE 'failed' END AS outcome, coalesce(quality, 0) AS success FROM documents LEFT JOIN labels USING (doc_id)", "documents", "labels")
QUERIES["j13_left_join_two_keys"] = lambda spark, sf_dir: E.with_attribute(
    table(spark, sf_dir, "events").select("user_id", "event_type"), table(spark, sf_dir, "events").withColumnRenamed("event_id", "last"), ["user_id", "event_type"], "last"
).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("last").alias("last"))
ORACLES["j13_left_join_two_keys"] = "SELECT event_type, count(*) AS n, CAST(sum(last) AS BIGINT) AS last FROM events LEFT JOIN (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL) USING (user_id, event_type) GROUP BY event_type"
on_tables("j14_set_valued_join", lambda o, l: E.with_set(o.withColumnRenamed("o_orderkey", "l_orderkey"), l, "l_orderkey", "l_returnflag", "flags").select(F.col("l_orderkey").alias("o_orderkey"), "flags"), "SELECT o_orderkey, flags FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1) USING (o_orderkey)", "orders", "lineitem")
on_tables("j16_next_turn", lambda c: E.next_in_run(c, "conv_id", "turn", "role", "reply").select("conv_id", "turn", "role", "reply"), "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations", "conversations")

# counts
ci_th = lambda ci: ci.where(X.matches("symbol", "th*", True))
on_index("a1_total", lambda ci: ci_th(ci).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ci WHERE symbol LIKE 'th%'")
on_index("a2_filtered_files", lambda ci: S.count_files(S.filtered(ci, parse_command("x -i func -f src1%"))), "SELECT count(DISTINCT directory || filename) AS files FROM ci WHERE context = 'FUNC' AND filename LIKE 'src1%'")
on_index("a3_result_files", lambda ci: S.count_files(S.select_rows(ci, parse_command("oner% ther% --and 2"))), f", {_GOOD} SELECT count(DISTINCT directory || filename) AS files FROM good")
ORACLES["a3_result_files"] = ORACLES["a3_result_files"].replace("\n, ", ",\n", 1)
on_index("a4_unfiltered_pattern", lambda ci: ci.where(X.matches("full_symbol", "The*")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ci WHERE translate(full_symbol, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'the%'")
on_index("a5_breakdown", lambda ci: S.breakdown(ci_th(ci)), "SELECT context, count(*) AS n FROM ci WHERE symbol LIKE 'th%' GROUP BY context")
on_index("a6_widths", lambda ci: S.widths(ci, ["symbol", "context", "line"]), "SELECT CAST(max(length(symbol)) AS INTEGER) AS symbol, CAST(max(length(context)) AS INTEGER) AS context, CAST(max(length(CAST(line AS VARCHAR))) AS INTEGER) AS line FROM ci")
on_index("a10_summary", S.summary, "SELECT count(*) AS total, count(DISTINCT directory || filename) AS files, count(DISTINCT symbol) AS symbols, CAST(sum(is_definition) AS BIGINT) AS definitions FROM ci")
on_index("a11_definitions_per_file", R.definitions_per_file, f"SELECT {FILE}, count(*) AS n FROM ci WHERE is_definition = 1 GROUP BY ALL ORDER BY n DESC, directory, filename LIMIT 10")
on_index("a12_functions_per_file", R.functions_per_file, f"SELECT {FILE}, count(*) AS n FROM ci WHERE is_definition = 1 AND context = 'FUNC' GROUP BY ALL ORDER BY n DESC, directory, filename LIMIT 10")
on_index("a13_hotspots", R.hotspots, f"SELECT {FILE}, CAST(sum(is_definition) AS BIGINT) AS definitions, count(*) FILTER (context = 'CALL') AS calls FROM ci GROUP BY directory, filename HAVING definitions > 50 AND calls > 10")
on_index("a14_methods_per_class", R.methods_per_class, "SELECT parent_symbol, count(*) AS n FROM ci WHERE context = 'VAR' AND parent_symbol <> '' GROUP BY 1 ORDER BY n DESC, parent_symbol LIMIT 15")
on_index("a15_arguments_per_function", R.arguments_per_function, f"SELECT parent_symbol, {FILE}, count(*) AS n FROM ci WHERE context = 'ARG' AND parent_symbol <> '' GROUP BY ALL ORDER BY n DESC, parent_symbol, directory, filename LIMIT 15")
on_index("a16_same_type_arguments", lambda ci: R.same_type_arguments(ci, 2).drop("function"), f"SELECT a.directory, a.filename, f.line AS function_line, a.type, count(*) AS n FROM (SELECT * FROM ci WHERE context = 'ARG') a ASOF JOIN (SELECT DISTINCT {FILE}, line FROM ci WHERE context = 'FUNC') f ON a.directory = f.directory AND a.filename = f.filename AND a.line >= f.line GROUP BY ALL HAVING n >= 2")
on_index("a17_fan_in", R.fan_in, "SELECT lower(symbol) AS symbol, count(*) AS n FROM ci WHERE is_definition = 0 AND context <> 'COM' GROUP BY 1 ORDER BY n DESC, symbol LIMIT 20")
on_index("a18_coupling", R.coupling, "SELECT symbol, count(DISTINCT directory || filename) AS n FROM ci WHERE context = 'CALL' GROUP BY 1 HAVING n > 5 ORDER BY n DESC, symbol LIMIT 20")
on_files("a19_imports", R.imports_per_module, f"SELECT {FILE}, count(*) AS n FROM cx WHERE context = 'IMP' GROUP BY ALL ORDER BY n DESC, directory, filename LIMIT 20")
on_index("a20_exports", R.exports_per_file, f"SELECT {FILE}, count(*) AS n FROM ci WHERE scope = 'public' AND is_definition = 1 GROUP BY ALL")
on_index("a21_reused_names", R.reused_names, "SELECT symbol, count(DISTINCT directory || filename) AS n FROM ci WHERE context = 'VAR' AND is_definition = 1 GROUP BY 1 ORDER BY n DESC, symbol LIMIT 25")
on_index("a22_generic_names", R.generic_names, "SELECT symbol, count(*) AS n FROM ci WHERE context IN ('VAR', 'ARG') AND symbol IN ('an', 'on', 'it', 'en', 'er', 'un') GROUP BY 1")
on_index("a23_naming", R.naming, "SELECT CASE WHEN context = 'FUNC' THEN 'capital function' ELSE 'small variable' END AS kind, count(*) AS n FROM ci WHERE is_definition = 1 AND (context = 'FUNC' AND full_symbol[1] BETWEEN 'A' AND 'Z' OR context = 'VAR' AND full_symbol[1] BETWEEN 'a' AND 'z') GROUP BY 1")
on_index("a24_comment_density", R.comment_density, f"SELECT {FILE}, count(*) AS total, round(count(*) FILTER (context = 'COM') / count(*), 3) AS density FROM ci GROUP BY directory, filename HAVING count(*) > 100")

# tables of contents
on_files("p10_toc_rows", lambda cx: C.toc_rows(cx, parse_command("an% --toc")).drop("source_location"), f"SELECT DISTINCT {FILE}, context, full_symbol, coalesce(span_start, line) AS start_line, line FROM cx WHERE (is_definition = 1 OR context IN ('IMP', 'FILE')) AND context IN ('FILE', 'CLASS', 'FUNC', 'ENUM', 'TYPE', 'MACRO', 'IMP') AND symbol LIKE 'an%'")
_TOC = f"t AS (SELECT DISTINCT {FILE}, context, full_symbol, coalesce(span_start, line) AS start_line, line, source_location FROM cx WHERE (is_definition = 1 OR context IN ('IMP', 'FILE')) AND context IN ('FILE', 'CLASS', 'FUNC', 'ENUM', 'TYPE', 'MACRO', 'IMP'))"
on_files("a7_toc_counts", lambda cx: C.toc_counts(C.toc_rows(cx, QuerySpec())), f", {_TOC} SELECT context, CASE WHEN context = 'IMP' THEN count(DISTINCT full_symbol) ELSE count(*) END AS n FROM t GROUP BY context")
on_files("a8_toc", lambda cx: C.toc(cx, QuerySpec()).select("directory", "filename", F.size("func").cast("long").alias("funcs"), F.size("class").cast("long").alias("classes"), F.array_join(F.col("class.full_symbol"), ",").alias("class_names"), "imports", F.col("align").cast("long").alias("align")), f", {_TOC} SELECT {FILE}, count(*) FILTER (context = 'FUNC') AS funcs, count(*) FILTER (context = 'CLASS') AS classes, coalesce(string_agg(full_symbol, ',' ORDER BY start_line, full_symbol) FILTER (context = 'CLASS'), '') AS class_names, coalesce(string_agg(DISTINCT full_symbol, ', ' ORDER BY full_symbol) FILTER (context = 'IMP'), '') AS imports, CAST(least(40, max(length(full_symbol))) AS BIGINT) AS align FROM t GROUP BY directory, filename")
on_files("a9_imports_of_file", lambda cx: C.toc(cx, parse_command("% --toc -i import")).select("directory", "filename", "imports"), f"SELECT {FILE}, string_agg(DISTINCT full_symbol, ', ' ORDER BY full_symbol) AS imports FROM cx WHERE context = 'IMP' GROUP BY directory, filename")
on_files("w3_toc_limits", lambda cx: C.toc(cx, parse_command("% --toc -x file import -lpf 2 -l 30")).select("directory", "filename", F.size("func").cast("long").alias("funcs"), F.size("class").cast("long").alias("classes")), f", {_TOC}, k AS (SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY line, context, full_symbol) AS n FROM t WHERE context NOT IN ('FILE', 'IMP')), m AS (SELECT * FROM k WHERE n <= 2 ORDER BY {FILE}, line, context, full_symbol LIMIT 30) SELECT {FILE}, count(*) FILTER (context = 'FUNC') AS funcs, count(*) FILTER (context = 'CLASS') AS classes FROM m GROUP BY directory, filename")
for _n in ("a7_toc_counts", "a8_toc", "w3_toc_limits"):
    ORACLES[_n] = ORACLES[_n].replace("\n, ", ",\n", 1)

# windows, limits, sets
on_index("w1_limit_per_file", lambda ci: S.limited(ci.where("context IN ('FUNC', 'CLASS')"), QuerySpec(limit_per_file=2)).select(*COLS), f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY line, seq) AS n FROM ci WHERE context IN ('FUNC', 'CLASS')) WHERE n <= 2")
on_index("w2_both_limits", lambda ci: S.limited(ci_th(ci), QuerySpec(limit_per_file=3, limit=100)).select(*COLS), f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY line, seq) AS n FROM ci WHERE symbol LIKE 'th%') WHERE n <= 3 ORDER BY {FILE}, line, seq LIMIT 100")
on_index("w4_file_changes", lambda ci: E.group_breaks(ci_th(ci), ["directory", "filename"], ["line", "seq"]).select("directory", "filename", "line", "seq"), f"SELECT {FILE}, line, seq FROM (SELECT *, row_number() OVER (PARTITION BY {FILE} ORDER BY line, seq) AS n FROM ci WHERE symbol LIKE 'th%') WHERE n = 1")
on_index("w5_pattern_sets", lambda ci: ci.withColumn("p", S.pattern_ids(("an%", "th%"))).where(F.size("p") > 0).groupBy("directory", "filename", "line").agg(F.size(F.array_distinct(F.flatten(F.collect_set("p")))).cast("long").alias("n")), f"SELECT {FILE}, line, count(DISTINCT CASE WHEN symbol LIKE 'an%' THEN 0 ELSE 1 END) AS n FROM ci WHERE symbol LIKE 'an%' OR symbol LIKE 'th%' GROUP BY ALL")
on_tables("w6_running_total", lambda o: E.running_total(o, "o_orderpriority", "o_orderkey", "o_totalprice", "running").select("o_orderkey", F.round("running", 2).alias("running")), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders", "orders")
on_tables("w7_average_ranks", lambda p: A.average_ranks(p, "p_size", "p_brand").select("p_brand", "v", "rank"), "SELECT DISTINCT p_brand, p_size AS v, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part", "part")
on_tables("w8_latest_attempt", lambda e: E.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", "events")
on_tables("w9_turn_ordinals", lambda e: E.turn_numbers(e, "user_id", ["ts", "event_id"]).select("event_id", "turn", F.round("part", 6).alias("part")), "SELECT event_id, CAST(row_number() OVER o AS INTEGER) AS turn, round(row_number() OVER o / count(*) OVER (PARTITION BY user_id), 6) AS part FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)", "events")
on_tables("w10_streaks", lambda e: A.streaks(e, "user_id", "event_id", "event_type"), "SELECT user_id, event_type, max(n) AS longest FROM (SELECT user_id, event_type, i, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) GROUP BY ALL) GROUP BY ALL", "events")
on_tables("w11_thirds", lambda e: A.thirds(e, "user_id", "event_id").groupBy("third", "event_type").agg(F.count("*").alias("n")), "SELECT CAST(least(2, (i * 3) // n) AS INTEGER) AS third, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY ALL", "events")
QUERIES["w12_never_after_first"] = lambda spark, sf_dir: E.never_after(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "purchase", "click")
ORACLES["w12_never_after_first"] = "SELECT user_id FROM events GROUP BY user_id HAVING min(event_id) FILTER (event_type = 'purchase') IS NOT NULL AND coalesce(max(event_id) FILTER (event_type = 'click') < min(event_id) FILTER (event_type = 'purchase'), true)"
on_tables("w13_balanced_sample", lambda c: E.balanced(c, "c_mktsegment", ["c_custkey"], 23).select("c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) ORDER BY rn, c_mktsegment LIMIT 23", "customer")
on_tables("w14_divided_calls", lambda l: E.divided(l.select("l_orderkey", F.col("l_quantity").cast("int").alias("n")), "n", 100).select("l_orderkey", "part"), "SELECT l_orderkey, unnest(list_transform(range(CAST(l_quantity AS INTEGER)), lambda x: round(100.0 / CAST(l_quantity AS INTEGER), 6))) AS part FROM lineitem WHERE CAST(l_quantity AS INTEGER) > 0", "lineitem")
on_tables("w15_tie_term", lambda p: A.average_ranks(p, "p_size").agg(F.sum("tie_term").cast("double").alias("ties")), "SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*) AS c FROM part WHERE p_size IS NOT NULL GROUP BY p_size)", "part")
on_index("o7_busiest_files", lambda ci: C.busiest_files(ci_th(ci)), f"SELECT {FILE}, n, t - 3 AS others FROM (SELECT {FILE}, count(*) AS n, count(*) OVER () AS t FROM ci WHERE symbol LIKE 'th%' GROUP BY directory, filename) ORDER BY n DESC, directory, filename LIMIT 3")
on_index("o2_file_list", lambda ci: S.files(ci, parse_command("oner%")), f"SELECT DISTINCT {FILE} FROM ci WHERE symbol LIKE 'oner%'")
on_index("u1_intersect", lambda ci: ci.where("symbol LIKE 'an%'").select("directory", "filename", "line").intersect(ci.where("symbol LIKE 'th%'").select("directory", "filename", "line")), f"SELECT {FILE}, line FROM ci WHERE symbol LIKE 'an%' INTERSECT SELECT {FILE}, line FROM ci WHERE symbol LIKE 'th%'")
on_index("u2_union_all", lambda ci: ci.where("context = 'FUNC'").select("symbol").unionByName(ci.where("context = 'CLASS'").select("symbol")).groupBy("symbol").agg(F.count("*").alias("n")), "SELECT symbol, count(*) AS n FROM (SELECT symbol FROM ci WHERE context = 'FUNC' UNION ALL SELECT symbol FROM ci WHERE context = 'CLASS') GROUP BY symbol")
on_index("u6_difference", lambda ci: S.difference(ci.where("context = 'VAR'"), ci.where("context = 'ARG'")), "SELECT symbol FROM ci WHERE context = 'VAR' EXCEPT SELECT symbol FROM ci WHERE context = 'ARG'")
on_tables("u7_required_sets", lambda l: E.required(l, "l_orderkey", "l_returnflag", ["A", "N"]), "SELECT l_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N')) = 2 AS all_there, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N')) AS some FROM lineitem GROUP BY 1", "lineitem")
on_tables("u8_key_union", lambda r, n: E.key_union(r.select(F.col("r_name").alias("name"), F.lit(1).alias("region")), n.select(F.col("n_name").alias("name"), F.lit(1).alias("nation"))), "SELECT r_name AS name, 1 AS region, NULL::INTEGER AS nation FROM region UNION ALL SELECT n_name, NULL, 1 FROM nation", "region", "nation")

# text functions, expansion, diagnosis
_tokens = lambda d: d.select("doc_id", F.explode(F.split("text", r"\s+")).alias("raw")).where("raw <> ''")
_TOK = r"SELECT doc_id, raw FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS raw FROM documents) WHERE raw <> ''"
on_tables("f1_admission", lambda d: _tokens(d).where(X.admitted(F.col("raw"), keywords=("if", "else", "return"))).groupBy("doc_id").agg(F.count("*").alias("n")), f"SELECT doc_id, count(*) AS n FROM ({_TOK}) WHERE length(raw) >= 2 AND raw NOT IN ('[', ']', '{{', '}}', '(', ')', '=', '+', '+=', '++', ';', ',') AND NOT regexp_matches(raw, '^[0-9]+$') AND translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NOT IN ('if', 'else', 'return', {', '.join(repr(w) for w in X.STOPWORDS)}) AND NOT regexp_matches(raw, '{'|'.join(f'(?:{p})' for p in X.NOISE_PATTERNS)}') GROUP BY 1", "documents")
on_tables("f2_word_cleaner", lambda d: _tokens(d).select(X.clean_word(F.col("raw")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")), rf"SELECT word, count(*) AS n FROM (SELECT regexp_replace(raw, '{X.CLEAN}', '', 'g') AS word FROM ({_TOK})) WHERE word <> '' GROUP BY 1", "documents")
on_tables("f3_tokens", lambda d: _tokens(d).groupBy("doc_id").agg(F.count("*").alias("n")), f"SELECT doc_id, count(*) AS n FROM ({_TOK}) GROUP BY 1", "documents")
on_tables("f5_search_key", lambda d: _tokens(d).select(X.search_key(F.col("raw")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n")), f"SELECT regexp_replace(lower(raw), '[.,!?:;]+$', '') AS symbol, count(*) AS n FROM ({_TOK}) GROUP BY 1", "documents")
on_tables("f8_noise_patterns", lambda d: _tokens(d).where(F.col("raw").rlike("|".join(f"(?:{p})" for p in X.NOISE_PATTERNS))).groupBy("raw").agg(F.count("*").alias("n")), f"SELECT raw, count(*) AS n FROM ({_TOK}) WHERE regexp_matches(raw, '{'|'.join(f'(?:{p})' for p in X.NOISE_PATTERNS)}') GROUP BY 1", "documents")
on_index("f10_base_name", lambda ci: ci.select(X.base_name(F.col("filename")).alias("base")).distinct(), r"SELECT DISTINCT regexp_replace(filename, '\.[^.]*$', '') AS base FROM ci")
QUERIES["e1_expand"] = lambda spark, sf_dir: C.expand(S.select_rows(occurrences(spark, sf_dir), parse_command("ther% -i class func")), C.lines_of(table(spark, sf_dir, "documents"))).select("seq", "line_no", "text")
_LINES = "x AS (SELECT './' || lang || '/' AS directory, source || '_' || doc_id || '.txt' AS filename, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
ORACLES["e1_expand"] = f"WITH {SQL}, {_LINES} SELECT ci.seq, CAST(x.line_no AS INTEGER) AS line_no, x.text FROM ci JOIN x ON x.directory = ci.directory AND x.filename = ci.filename AND x.line_no BETWEEN ci.span_start AND greatest(ci.span_start, ci.span_end) WHERE ci.symbol LIKE 'ther%' AND ci.context IN ('CLASS', 'FUNC')"
QUERIES["e2_context_lines"] = lambda spark, sf_dir: C.expand(S.select_rows(occurrences(spark, sf_dir), parse_command("oner% -i call arg")), C.lines_of(table(spark, sf_dir, "documents")), 2, 1, False).select("seq", "line_no", "text")
ORACLES["e2_context_lines"] = f"WITH {SQL}, {_LINES} SELECT ci.seq, CAST(x.line_no AS INTEGER) AS line_no, x.text FROM ci JOIN x ON x.directory = ci.directory AND x.filename = ci.filename AND x.line_no BETWEEN greatest(1, ci.line - 2) AND ci.line + 1 WHERE ci.symbol LIKE 'oner%' AND ci.context IN ('CALL', 'ARG')"
on_index("e6_diagnosis", lambda ci: S.diagnose(ci, parse_command("an% -i func -f nosuch% -t t1")), "SELECT 'none' AS filter, count(*) FILTER (context = 'FUNC' AND filename LIKE 'nosuch%' AND type LIKE '%t1%') AS n FROM ci WHERE symbol LIKE 'an%' UNION ALL SELECT 'all', count(*) FROM ci WHERE symbol LIKE 'an%' UNION ALL SELECT 'include', count(*) FROM ci WHERE symbol LIKE 'an%' AND filename LIKE 'nosuch%' AND type LIKE '%t1%' UNION ALL SELECT 'files', count(*) FROM ci WHERE symbol LIKE 'an%' AND context = 'FUNC' AND type LIKE '%t1%' UNION ALL SELECT 'type', count(*) FROM ci WHERE symbol LIKE 'an%' AND context = 'FUNC' AND filename LIKE 'nosuch%'")

# statistics
_r = lambda df, *cols, k=6: df.select(*(c if c not in cols else F.round(c, k).alias(c) for c in df.columns))
on_tables("a25_group_summary", lambda l: _r(A.group_summary(l, "l_returnflag", "l_extendedprice").drop("total"), "mean", "median", "p90", "pstdev", "stdev", "geomean", "q1", "q3", k=3), """WITH v AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS xs, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT l_returnflag, (1 - (.25 * (n + 1) - floor(.25 * (n + 1)))) * xs[CAST(floor(.25 * (n + 1)) AS INTEGER)] + (.25 * (n + 1) - floor(.25 * (n + 1))) * xs[CAST(floor(.25 * (n + 1)) AS INTEGER) + 1] AS q1, (1 - (.75 * (n + 1) - floor(.75 * (n + 1)))) * xs[CAST(floor(.75 * (n + 1)) AS INTEGER)] + (.75 * (n + 1) - floor(.75 * (n + 1))) * xs[CAST(floor(.75 * (n + 1)) AS INTEGER) + 1] AS q3 FROM v)
    SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(quantile_cont(l_extendedprice, .5), 3) AS median, round(quantile_cont(l_extendedprice, .9), 3) AS p90, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(stddev_pop(l_extendedprice), 3) AS pstdev, round(stddev_samp(l_extendedprice), 3) AS stdev, round(exp(avg(ln(l_extendedprice))), 3) AS geomean, round(any_value(q1), 3) AS q1, round(any_value(q3), 3) AS q3 FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""", "lineitem")
on_tables("a26_percentile", lambda o: o.groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90")), "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1", "orders")
on_tables("a27_geometric_mean", lambda o: o.where("o_totalprice > 0").groupBy("o_orderstatus").agg(F.round(F.exp(F.avg(F.ln("o_totalprice"))), 3).alias("g")), "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 3) AS g FROM orders WHERE o_totalprice > 0 GROUP BY 1", "orders")


def _wilson(d: DataFrame, labels: DataFrame) -> DataFrame:
    s = d.join(labels, "doc_id").groupBy("lang").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = A.wilson(F.col("k"), F.col("n"))
    return s.select("lang", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


on_tables("a28_wilson", _wilson, "SELECT lang, k, n, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS low, round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS high FROM (SELECT lang, CAST(sum(toxic) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)", "documents", "labels")
_MWU = """WITH b AS (SELECT l_returnflag, l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem WHERE l_returnflag IN ('A', 'N')), s AS (SELECT CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS na, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS nb, sum(r) FILTER (l_returnflag = 'A') AS ra FROM b), t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS tt FROM (SELECT count(*) AS c FROM b GROUP BY l_quantity)), u AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM s, t)
    SELECT na, nb, u, round((u - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - {})), 6) AS z, round(2 * u / (na * nb) - 1, 9) AS rank_biserial FROM u"""
on_tables("a29_mann_whitney", lambda l: _r(_r(A.mann_whitney(l, "l_returnflag", "l_quantity", "A", "N"), "z"), "rank_biserial", k=9), _MWU.format("tt / ((na + nb) * (na + nb - 1))"), "lineitem")
on_tables("a30_mann_whitney_plain", lambda l: _r(_r(A.mann_whitney(l, "l_returnflag", "l_quantity", "A", "N", False), "z"), "rank_biserial", k=9), _MWU.format("0"), "lineitem")
_runs = lambda o: o.where("o_orderstatus IN ('F', 'O')").groupBy("o_orderpriority", "o_orderstatus", F.pmod("o_custkey", F.lit(7)).alias("rep")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
on_tables("a31_bootstrap", lambda o: A.bootstrap_median_difference(_runs(o), "o_orderpriority", "o_orderstatus", "v", "F", "O", 10_000), None, "orders")
on_tables("a32_log_ratio", lambda o: A.log_ratio(_runs(o), "o_orderpriority", "o_orderstatus", "v", "F", "O", 10_000), None, "orders")
_eff = lambda o: o.groupBy("o_orderpriority").agg(F.ln(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))).alias("effect"), (F.stddev_samp("o_totalprice") / F.avg("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
on_tables("a33_pooled_effect", lambda o: _r(A.pool(_eff(o)), "effect", "low", "high", "q", "i2", "pct"), "WITH e AS (SELECT ln(avg(o_totalprice) FILTER (o_orderstatus = 'F') / avg(o_totalprice) FILTER (o_orderstatus = 'O')) AS e, stddev_samp(o_totalprice) / avg(o_totalprice) / sqrt(count(*)) AS s FROM orders GROUP BY o_orderpriority), p AS (SELECT count(*) AS k, sum(1 / (s * s)) AS sw, sum(e / (s * s)) AS swe, sum(e * e / (s * s)) AS swee FROM e WHERE s > 0), r AS (SELECT k, swe / sw AS m, 1 / sqrt(sw) AS se, swee - swe * swe / sw AS q FROM p) SELECT k, round(m, 6) AS effect, round(m - 1.96 * se, 6) AS low, round(m + 1.96 * se, 6) AS high, round(q, 6) AS q, round(CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q) ELSE 0 END, 6) AS i2, round(exp(m) * 100 - 100, 6) AS pct FROM r", "orders")
on_tables("a34_arm_ratios", lambda l: E.arm_ratio(l, "l_returnflag", "l_linestatus", "l_quantity", "F", "O").select("l_returnflag", F.round("ratio", 9).alias("ratio")), "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'O') / avg(l_quantity) FILTER (l_linestatus = 'F'), 9) AS ratio FROM lineitem GROUP BY 1", "lineitem")
on_tables("a35_calls_per_run", lambda e: _r(E.calls_per_run(e, "user_id", {"clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view"}), "clicks", "views"), "SELECT round(avg(c), 6) AS clicks, round(avg(v), 6) AS views FROM (SELECT count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)", "events")
on_tables("a36_rates", lambda d, l: _r(E.rates(d.join(l, "doc_id"), "source", {"rate": F.col("quality"), "blown_up": F.col("n_chars") > 3000}), "rate", "blown_up", k=9), "SELECT source, round(avg(CAST(quality AS DOUBLE)), 9) AS rate, round(avg(CASE WHEN n_chars > 3000 THEN 1.0 ELSE 0.0 END), 9) AS blown_up FROM documents JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
on_tables("a37_cheapest", lambda o: E.cheapest_arm(o, "o_orderpriority", "o_orderstatus", "o_totalprice").select("o_orderpriority", "cheapest", F.round("cost", 4).alias("cost")), "SELECT o_orderpriority, arg_min(o_orderstatus, m) AS cheapest, min(m) AS cost FROM (SELECT o_orderpriority, o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS m FROM orders GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1", "orders")
on_tables("a38_most_common", lambda e: E.most_common(e, "user_id", "event_type", ["click", "view"]), "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1 ORDER BY click + view DESC, user_id LIMIT 20", "events")
on_tables("a39_exclusions", lambda d: E.exclusions(d, [("short", F.col("n_chars") < 100), ("language", F.col("lang") != "en"), ("long", F.col("n_chars") > 5000)]), "SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN n_chars > 5000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1", "documents")
on_tables("a40_adoption", lambda e: E.adoption(e, "event_type", {"high": F.col("value") > 50}).select("event_type", "n", F.round("high", 9).alias("high")), "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS high FROM events GROUP BY 1", "events")
on_tables("a41_largest_sibling", lambda d: E.largest_sibling(d, "source", "n_chars", "n"), "SELECT source, max(n_chars) AS n FROM documents GROUP BY 1", "documents")
on_tables("a42_spearman", lambda p: _r(A.spearman(p, "p_size", "p_retailprice"), "rho"), "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part) SELECT round(corr(x, y), 6) AS rho FROM r", "part")
on_tables("a43_resolve_rates", lambda d, l: E.resolved_by(d.join(l, "doc_id"), "source", "lang", "quality", ["de", "en", "es", "fr"]).drop("rate"), "SELECT source, " + ", ".join(f"CAST(sum(quality) FILTER (lang = '{x}') AS BIGINT) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
on_tables("a44_patch_stats", lambda p: p.select("page_id", F.regexp_count("html", F.lit("<p")).alias("paragraphs"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("links")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<p')) AS INTEGER) AS paragraphs, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INTEGER) AS links FROM pages", "pages")
on_tables("a45_trajectory_rollup", lambda c: E.trajectory_rollup(c, "conv_id", "role", F.length("text")).withColumnRenamed("tokens", "chars"), "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS peak, count(*) FILTER (role = 'assistant') AS calls FROM conversations GROUP BY 1", "conversations")
on_tables("a46_cost_model", lambda c: E.cost(c, "role", F.length("text") / 4, {"assistant": 0.000015, "user": 0.000003, "system": 0.000003}).select("role", F.round("cost", 6).alias("cost")), "SELECT role, round(sum(length(text)) / 4 * CASE WHEN role = 'assistant' THEN 0.000015 ELSE 0.000003 END, 6) AS cost FROM conversations GROUP BY role", "conversations")
on_tables("a47_pair_difference", lambda c: E.pair_change(c, "conv_id", "role", F.length("text"), "user", "assistant").select("conv_id", F.round("pct", 6).alias("pct")), "SELECT conv_id, round((CAST(sum(length(text)) FILTER (role = 'assistant') AS DOUBLE) - sum(length(text)) FILTER (role = 'user')) / sum(length(text)) FILTER (role = 'user') * 100, 6) AS pct FROM conversations GROUP BY 1", "conversations")
on_tables("a48_dimensions", lambda d, l: E.dimensions(d, l, "doc_id", "source", {"docs": F.count("*"), "scored": F.count("quality"), "breaks": F.sum(F.regexp_count("text", F.lit("\n")))}), "SELECT source, count(*) AS docs, count(quality) AS scored, CAST(sum(len(text) - len(replace(text, chr(10), ''))) AS BIGINT) AS breaks FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
on_tables("a49_completeness", lambda d, l: E.completeness(d.join(l, "doc_id", "left"), "source", "quality").select("source", "state"), "SELECT source, CASE WHEN count(quality) = count(*) THEN 'complete' WHEN count(quality) = 0 THEN 'missing' ELSE 'partial' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
on_tables("a50_pipe_rates", lambda p: p.groupBy((F.col("page_id") % 10).alias("g")).agg(F.round(F.avg(F.col("html").contains("&amp;").cast("double")), 9).alias("rate")), "SELECT page_id % 10 AS g, round(avg(CASE WHEN contains(html, '&amp;') THEN 1.0 ELSE 0.0 END), 9) AS rate FROM pages GROUP BY 1", "pages")
on_tables("a51_classification", lambda c: c.groupBy(E.classified(F.col("text"), [("question", r"\?$"), ("number", "[0-9]")]).alias("kind")).agg(F.count("*").alias("n")), r"SELECT CASE WHEN regexp_matches(text, '\?$') THEN 'question' WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'other' END AS kind, count(*) AS n FROM conversations GROUP BY 1", "conversations")
on_tables("t2_debounce", lambda e: A.debounced(e, "user_id", "ts", "event_type", "event_id", 3_600_000).select("user_id", "burst", "n", "kind"), "SELECT user_id, burst, count(*) AS n, arg_max(event_type, (ts, event_id)) AS kind FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL", "events")
on_tables("t2_session_window", lambda e: e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest")), "SELECT user_id, count(*) AS sessions, max(n) AS largest FROM (SELECT user_id, burst, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL) GROUP BY 1", "events")
on_tables("t3_first_event_wins", lambda e: A.debounced(e, "user_id", "ts", "event_type", "event_id", 3_600_000, first=True).select("user_id", "burst", "kind"), "SELECT user_id, burst, arg_min(event_type, (ts, event_id)) AS kind FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL", "events")

# labels, commands, words
on_tables("j15_label_to_batch", lambda r: E.match_label(r.select(F.substring("r_name", 1, 3).alias("label")), r.select("r_name"), "label", "r_name"), "SELECT substring(r_name, 1, 3) AS label, r_name FROM region", "region")
_QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)""".replace("'", "''")
_PARTS = rf"list_filter(list_transform(regexp_extract_all(html, '(?:{_QUOTED}|[^;\n|&''\"])+'), lambda x: trim(x, ' ')), lambda x: x <> '')"
on_tables(
    "f18_segments", lambda p: p.select("page_id", F.size(K.segments(F.col("html"))).alias("segments"), F.coalesce(F.get(K.programs(F.col("html")), F.lit(0)), F.lit("")).alias("program")),
    rf"SELECT page_id, CAST(len(s) AS INTEGER) AS segments, coalesce(regexp_extract(s[1], '^(?:\w+=\S+\s+)*(\S+)', 1), '') AS program FROM (SELECT page_id, {_PARTS} AS s FROM pages)", "pages",
)
on_tables("f18_pipes", lambda p: p.select("page_id", K.pipes(F.col("html")).cast("long").alias("pipes")), rf"SELECT page_id, CAST(len(x) - len(replace(x, '|', '')) AS BIGINT) AS pipes FROM (SELECT page_id, regexp_replace(html, '{_QUOTED}|\|\|', ' ', 'g') AS x FROM pages)", "pages")
_NOISE = "|".join(f"(?:{p})" for p in X.NOISE_PATTERNS)
_STOPS = ", ".join(f"'{w}'" for w in X.STOPWORDS)
on_tables(
    "f9_filter_reasons", lambda d: _tokens(d).groupBy(K.filter_reason(F.col("raw"), ("if", "else", "for", "while", "return")).alias("reason")).agg(F.count("*").alias("n")),
    f"""SELECT CASE WHEN length(raw) < 2 THEN 'short' WHEN regexp_matches(raw, '^[0-9]+$') THEN 'number' WHEN lower(raw) IN ({_STOPS}) THEN 'stopword' WHEN lower(raw) IN ('if', 'else', 'for', 'while', 'return') THEN 'keyword'
        WHEN raw IN ('+=', '++') OR regexp_matches(raw, '{_NOISE}') THEN 'pattern' ELSE 'valid' END AS reason, count(*) AS n FROM ({_TOK}) GROUP BY 1""", "documents",
)
on_tables(
    "f20_short_labels", lambda d: d.select(
        "doc_id", K.short_label(F.concat(F.lit("instance_x__"), F.upper("source"), F.lit("-"), "doc_id")).alias("label"), K.family(F.concat(F.lit("Model-"), "lang"), ("en", "de")).alias("family"), K.test_file(F.concat("source", F.lit("/t.py::"), "lang")).alias("file")),
    "SELECT doc_id, lower(split_part(split_part('instance_x__' || upper(source) || '-' || doc_id, '__', 2), '-', 1)) AS label, CASE WHEN lang = 'en' THEN 'en' WHEN lang IS NULL THEN NULL ELSE CASE WHEN contains(lower('Model-' || lang), 'en') THEN 'en' WHEN contains(lower('Model-' || lang), 'de') THEN 'de' ELSE 'Model-' || lang END END AS family, source || '/t.py' AS file FROM documents", "documents",
)
on_tables("f21_open_ranges", lambda d: d.agg(F.count_if(K.in_range(F.col("n_chars"), "500-")).alias("long"), F.count_if(K.in_range(F.col("n_chars"), "-200")).alias("short"), F.count_if(K.in_range(F.col("n_chars"), "300-900")).alias("middle")), "SELECT count(*) FILTER (n_chars >= 500) AS long, count(*) FILTER (n_chars <= 200) AS short, count(*) FILTER (n_chars BETWEEN 300 AND 900) AS middle FROM documents", "documents")
on_tables("f22_durations", lambda o: o.select("o_orderkey", K.duration(F.col("o_totalprice") / 100).alias("took")), "SELECT o_orderkey, printf('%dm%02ds', CAST(floor(floor(o_totalprice / 100) / 60) AS BIGINT), CAST(floor(o_totalprice / 100) AS BIGINT) % 60) AS took FROM orders", "orders")
on_tables("f22_parallelism", lambda e: _r(_r(E.parallelism(e.select("event_type", "ts", (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("done")), "event_type", "ts", "done"), "parallelism"), "busy", "wall", k=3), "SELECT event_type, round(b, 3) AS busy, round(w, 3) AS wall, round(b / w, 6) AS parallelism FROM (SELECT event_type, CAST(count(*) * 90 AS DOUBLE) AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + 90 AS w FROM events GROUP BY 1)", "events")
