"""Commands, outputs, labels, readers, experiment operators and rendering on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from symsift import render
from symsift.functions import commands as K
from symsift.operators import runs as E
from symsift.operators import search as S
from symsift.operators import toc as C
from symsift.plans.spec import QuerySpec, parse_command
from symsift.sources import files as X
from symsift.sources.files import IndexStore
from test_engine import rows_of


def column(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_shell_commands(spark):
    commands = ["a 'x;y' | b && c", "X=1 Y=2 grep z", "", "symsift a; echo =; symsift b", "cat a; cat b", "cat a; sed -n 1p b", "sed -i s/a/b/ f", "grep x | head", "cat 'open; still", "a || b | c", None]
    assert column(spark, K.segments, commands) == [["a 'x;y'", "b", "c"], ["X=1 Y=2 grep z"], [], ["symsift a", "echo =", "symsift b"], ["cat a", "cat b"], ["cat a", "sed -n 1p b"], ["sed -i s/a/b/ f"], ["grep x", "head"], ["cat 'open; still"], ["a", "b", "c"], None]
    assert column(spark, K.programs, commands)[:4] == [["a", "b", "c"], ["grep"], [], ["symsift", "echo", "symsift"]]
    assert column(spark, K.action_tool, commands) == [None, "search", None, "own", "cat", "mixed", None, "search", "cat", None, None]
    assert column(spark, lambda c: K.only_tool(c, "search"), commands)[1:8] == [True, False, False, False, False, False, True]
    assert column(spark, K.sub_commands, commands)[3] == ["symsift a", "symsift b"]
    assert column(spark, K.pipes, commands)[:1] + column(spark, K.pipes, commands)[9:10] == [1, 1]
    traits = lambda name: column(spark, lambda c: K.pattern_traits(c)[name], ["symsift a.b", "symsift 'a b' -f /x", "symsift a"])
    assert traits("dotted") == [True, False, False] and traits("phrase") == [False, True, False] and traits("absolute") == [False, True, False]


def test_outputs(spark):
    outputs = ["LINE  SYM\n\n12 matches", "3 of 40 matches", "4     alpha\n5     beta", "No results\nnot indexed", "no matches: no symbol x", "No results without that filter there are 3", "help", "returncode: -2"]
    assert column(spark, K.result_count, outputs) == [12, 40, 2, 0, 0, 0, None, None]
    assert column(spark, K.miss_kind, outputs) == ["", "", "", "not_indexed", "absent", "filtered", "", ""]
    assert column(spark, K.return_code, outputs)[-1] == -2


def test_labels_and_ranges(spark):
    assert column(spark, K.short_label, ["instance_org__Web-abc-1", "plain", "a__b"]) == ["web", "plain", "b"]
    assert column(spark, K.test_file, ["a.ts | d::c", "a.py::C::t", "TestX"]) == ["a.ts", "a.py", "TestX"]
    assert column(spark, K.normal_id, ["x-v12ab", "x", None]) == ["x", "x", ""]
    assert column(spark, K.repr_list, ["['a', \"b's\"]", "nonsense(", None, "(1, 2)"]) == [["a", "b's"], [], [], ["1", "2"]]
    assert [K.parse_open_range(x) for x in ("4-6", "4", "4-", "-6")] == [(4, 6), (4, 4), (4, None), (None, 6)]
    assert column(spark, lambda c: K.in_range(c, "-6"), [5, 6, 7], "int") == [True, True, False]
    assert column(spark, K.duration, [0.0, 61.9, 3600.0], "double") == ["0m00s", "1m01s", "60m00s"]
    assert column(spark, K.filter_reason, ["x", "12", "the", "12px", "word"]) == ["short", "number", "stopword", "pattern", "valid"]
    assert K.plural("match") == "matches" and K.plural("file") == "files"


def test_sql_text():
    assert K.widened("abc -i func abc", "abc") == "*abc* -i func abc" and K.widened("abcd", "abc") == "abcd"
    sql = "SELECT 1 FROM t WHERE x LIKE 'ORDER BY ''LIMIT' AND EXISTS (SELECT 1 LIMIT 1) ORDER BY x LIMIT 5"
    assert sql[K.tail_clause(sql) :] == "ORDER BY x LIMIT 5" and K.tail_clause("SELECT 1") == -1
    assert K.with_clause(sql, "AND y = 1").endswith("AND y = 1 ORDER BY x LIMIT 5") and K.with_clause("a", " b") == "a b"


def test_readers(spark, tmp_path):
    (tmp_path / "w").write_text("# c\nalpha\n\nbeta\n")
    (tmp_path / "r").write_text("^a+$\n[b\n")
    (tmp_path / "e").write_text("c\n.h\n")
    (tmp_path / "none").write_text("# only\n")
    at = lambda n: str(tmp_path / n)
    assert X.read_word_list(spark, at("w")) == ["alpha", "beta"] and X.read_extension_list(spark, at("e")) == [".c", ".h"]
    assert len(X.preflight(spark, words=(at("w"), at("none"), at("missing")), patterns=(at("r"),), extensions=(at("e"),))) == 3
    with pytest.raises(ValueError, match="more than 1"):
        X.read_lines(spark, at("w"), 1, 9)
    assert [r.name for r in X.read_manifest(spark, at("w")).collect()] == ["alpha", "beta"]
    (tmp_path / "t.json").write_text(json.dumps({"instance_id": "i1", "info": {"exit_status": "ok", "model_stats": {"instance_cost": 1.5}}, "messages": [{"role": "user", "content": "go", "tokens": 2}, {"role": "assistant", "content": "ls", "tokens": 3}]}, indent=1))
    got = X.read_trajectories(spark, at("t.json"))
    assert [(r.instance_id, r.cost, r.turn, r.role, r.content) for r in got.orderBy("turn").collect()] == [("i1", 1.5, 1, "user", "go"), ("i1", 1.5, 2, "assistant", "ls")]
    assert X.pattern_extension("%/a.foo%") == ".foo" and X.pattern_extension("a") is None and X.pattern_extension("a.%") is None
    assert "Only source code" in X.extension_warning((".c", "x.MD")) and X.extension_warning((".c",)) is None and "not indexed" in X.extension_warning(("*.zig",))
    assert len(X.PLAINTEXT) == 36 and X.is_plaintext(".Readme") and ".rs" in X.known_extensions()
    assert X.resolve_data_file("w", str(tmp_path)) == at("w") and X.resolve_data_file("nothing-here") is None


def test_patches(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@\n-old\n+new\n+more\ndiff --git a/y b/y\n+z\ndiff --git a/x.py b/x.py\n"
    df = spark.createDataFrame([(patch,), ("",)], "p string").select(*E.patch_stats(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [(2, 3, 1), (0, 0, 0)]


def test_experiments(spark):
    batches = spark.createDataFrame([("run-alpha-1",), ("run-beta",)], "batch string")
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    assert [r.batch for r in E.match_label(names("alpha"), batches, "label", "batch").collect()] == ["run-alpha-1"]
    for bad in ("run", "gamma"):
        with pytest.raises(Exception, match="stands in"):
            E.match_label(names(bad), batches, "label", "batch").collect()
    rows = spark.createDataFrame([("i", "a", 1.0), ("i", "a", 3.0), ("i", "a", 2.0), ("i", "b", 1.0)], "inst string, arm string, c double")
    assert E.cheapest_arm(rows, "inst", "arm", "c").first().cheapest == "a"
    side = E.side_by_side(rows.groupBy("inst", "arm").agg(F.max("c").alias("c")), "inst", "arm", "c", ["a", "b"]).first()
    assert (side.a, side.b) == (3.0, 1.0)
    assert column(spark, lambda c: E.affordable_runs(c, 10), [3.0, 0.0], "double") == [3, None]
    df = spark.createDataFrame([(-8.83, 0.01), (2.0, 0.2)], "pct double, p double")
    assert [r.s for r in df.select(E.starred(F.col("pct"), F.col("p")).alias("s")).collect()] == ["-8.8%*", "+2.0%"]
    turns = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "run int, turn int, tool string")
    assert tuple(E.first_last_use(turns, "run", "turn", F.col("tool") == "x").first()) == (1, 1, 3)
    with pytest.raises(Exception, match="no price"):
        E.cost(turns, "tool", F.col("turn"), {"x": 1}).collect()


def test_summary_csv(spark, tmp_path):
    E.write_summary(E.key_union(spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")), f"file://{tmp_path}/s")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/s")
    assert got.columns == ["a", "b"] and got.count() == 2


def test_rendering(spark):
    ci = rows_of(spark, [{"symbol": "f<", "context": "FUNC", "is_definition": 1, "line": 2, "span_start": 2, "span_end": 3, "source_location": "2:2 - 3:1"}, {"symbol": "g", "line": 3}])
    lines = spark.createDataFrame([("./", "a.c", n, t) for n, t in ((1, "one"), (2, "ab{ x"), (3, "} rest"))], "directory string, filename string, line_no int, text string")
    assert [r.text for r in C.trimmed(ci, lines).collect()] == ["{ x", "}"]
    assert list(render.source_lines(ci, lines, parse_command("f% -e --raw"))) == ["ab{ x", "} rest"]
    assert list(render.source_lines(ci, lines, parse_command("f% -e")))[0] == "\n./a.c: f<"
    page = "".join(render.web_table(ci, parse_command("f%")))
    assert "f&lt;" in page and "No results" in "".join(render.web_table(ci, parse_command("nosuch"))) and "FUNC 1" in render.web_breakdown(ci, QuerySpec())
    assert "Physical Plan" in render.debug(ci, QuerySpec()) and "--lines" in render.usage()[1]
    found = S.culprits(ci, parse_command("g -i func --def"))
    assert [(r["filter"], r.n) for r in found.collect()] == []
    assert [(r["filter"], r.n) for r in S.culprits(ci, parse_command("g -i func")).collect()] == [("include", 1)]
    assert not parse_command("x --lines 3 --within f --parent-type t").has_filters() and parse_command("x --def").has_filters()


def test_store_has_one_version_per_batch(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/store")
    rows = lambda *names: rows_of(spark, [{"symbol": n, "filename": f"{n}.c"} for n in names]).withColumn("lang", F.lit("c"))
    store.upsert(rows("a", "b", "c"))
    store.apply(rows("a", "d"), rows("b").select("directory", "filename"))
    assert sorted(r.symbol for r in store.read().collect()) == ["a", "c", "d"] and store.versions() == [1, 2]
    stale = IndexStore(spark, store.path)
    stale.versions = lambda: [1]  # another writer made version 2 in between
    with pytest.raises(RuntimeError, match="another writer"):
        stale.write(rows("z"))
    assert sorted(r.symbol for r in store.read().collect()) == ["a", "c", "d"]
