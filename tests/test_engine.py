"""The occurrence engine: SQL twins, commands, patterns, extraction, store and watcher."""

import inspect
import math
import os
import statistics
import time
from collections import Counter

import duckdb
import pytest

from symsift import api
from symsift.functions import text as X
from symsift.operators import search as S
from symsift.operators import stats as A
from symsift.plans import registry
from symsift.plans.spec import CommandError, defaults_from_config, parse_command
from symsift.schema import SCHEMA
from symsift.sources import occurrences as O
from symsift.sources.extract import extract, extract_file
from symsift.sources.files import IndexStore, Walk, glob_regex, read_tree

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in res.fetchall())


def rows_of(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(SCHEMA.names, "") | {"directory": "./", "filename": "a.c", "line": 1, "context": "VAR", "is_definition": 0, "seq": i, "span_start": None, "span_end": None} | r
        base["full_symbol"] = base["full_symbol"] or base["symbol"]
        full.append(tuple(base[n] for n in SCHEMA.names))
    return spark.createDataFrame(full, SCHEMA)


def test_pattern_table(spark):
    ci = rows_of(spark, [{"symbol": s} for s in ("db_init", "dbxinit", "get*", "getall", "a%b", "a\\b", "é", "some.function", "o'clock")])
    found = lambda p: [r.symbol for r in ci.where(X.matches("symbol", p, True)).orderBy("seq").collect()]
    assert found("db_init") == ["db_init", "dbxinit"]
    assert found(r"db\_init") == ["db_init"]
    assert found(r"get\*") == ["get*"]
    assert found("get*") == ["get*", "getall"]
    assert found(r"a\%b") == ["a%b"] and found(r"a\\b") == ["a\\b"] and found("É") == [] and found("o'c*") == ["o'clock"]
    assert found("DB.INIT") == ["db_init", "dbxinit"]


def test_proximity_modes(spark):
    ci = rows_of(spark, [{"symbol": s, "line": n} for s, n in (("a1", 10), ("b1", 5), ("c1", 15), ("a2", 12))])
    run = lambda mode: sorted(r.line for r in S.proximity(ci, ci, ("a%", "b%", "c%"), 5, mode).collect())
    assert run("set") == [5, 10, 15] and run("web") == [10]
    two = sorted(r.line for r in S.proximity(ci, ci, ("a%", "c%"), 5, "native").collect())
    assert two == [10, 12, 15, 15]  # both anchors repeat the row at 15


def test_proximity_in_equal_files(spark):
    """Rows of two files that are alike stay rows of two files."""
    files = [(d, n, "python", "alpha = 1\nbeta = alpha\n") for d, n in (("./", "a.py"), ("./", "b.py"), ("./sub/", "a.py"))]
    rows, _ = extract(spark.createDataFrame(files, "directory string, filename string, lang string, content string"))
    got = Counter((r.directory, r.filename, r.line) for r in S.proximity(rows, rows, ("alpha", "beta"), 3).collect())
    assert got == Counter((d, n, line) for d, n, *_ in files for line in (1, 2, 2))


def test_within_and_expand(spark):
    ci = rows_of(spark, [
        {"symbol": "f", "context": "FUNC", "is_definition": 1, "line": 2, "span_start": 2, "span_end": 4}, {"symbol": "f", "filename": "b.c", "context": "FUNC", "is_definition": 1, "line": 7, "span_start": 7, "span_end": 9},
        {"symbol": "x", "line": 3}, {"symbol": "x", "line": 5}, {"symbol": "x", "filename": "b.c", "line": 8},
    ])
    assert sorted((r.filename, r.line) for r in api.search(ci, "x --within f").collect()) == [("a.c", 3), ("b.c", 8)]
    with pytest.raises(ValueError, match="nosuch"):
        api.search(ci, "x --within nosuch")
    lines = spark.createDataFrame([("./", "a.c", n, f"line {n}") for n in range(1, 9)], "directory string, filename string, line_no int, text string")
    got = api.expand(ci.where("seq = 0"), lines, 1, 1).collect()
    assert [r.line_no for r in got] == [1, 2, 3, 4, 5]


def test_recovery(spark):
    ci = rows_of(spark, [{"symbol": "render", "parent_symbol": "page"}, {"symbol": "prerender"}])
    assert [r.symbol for r in api.search(ci, "page.render").collect()] == ["render"]
    assert [r.symbol for r in api.search(ci, "rende").collect()] == ["render", "prerender"]
    assert api.search(ci, "rende", recover=False).count() == 0


def test_commands():
    s = parse_command("a* 'b|c' -i func var -x noise -f .c src/ -p x --def -l 5 -lpf 2 --lines 3-9 -C 4")
    assert s.patterns == ("a*", "b", "c") and s.include == ("FUNC", "VAR") and s.contexts() == (("FUNC", "VAR"), ())
    assert (s.limit, s.limit_per_file, s.lines, s.before, s.after, s.definition) == (5, 2, (3, 9), 4, 4, (1,))
    assert parse_command("app.run").qualified == ("app", "run")
    for bad in ("'a b'", "x -i func,var", "x -i nosuch", "x --nosuch", "x --and", "x --lines 9-3", "x -C 101", "% --toc -e", "x -l"):
        with pytest.raises(CommandError):
            parse_command(bad)
    assert defaults_from_config("[a]\n--limit 5\n-x noise\n[b]\n-l 1", "a", ["-x"]) == ["--limit", "5"]


def test_file_patterns():
    assert X.file_pattern(".c") == (None, "%\\.c") and X.file_pattern("x.h") == (None, "x.h")
    assert X.file_pattern("a/b/x.c") == ("%/a/b/", "x.c") and X.file_pattern("src/") == ("%/src/", "%") and X.file_pattern("/r/x.c") == ("/r/", "x.c")
    assert glob_regex("*.min.js") and Walk(ignore=("build*",)).accepts("src/a.c") and not Walk(ignore=("build*",)).accepts("build-x/a.c")


PY = 'import os as o\n\nclass A(Base):\n    """doc word"""\n    def run(self, n: int, *args) -> str:\n        self.total = helper(n)  # a note here\n        return [x for x in args]\n'


def test_python_extraction():
    rows, error = extract_file("./", "m.py", "python", PY)
    assert not error
    got = {(r["context"], r["full_symbol"], r["line"]): r for r in rows}
    assert got[("FILE", "m", 1)] and got[("IMP", "o", 1)]["clue"] == "os"
    assert got[("CLASS", "A", 3)]["parent_symbol"] == "Base" and got[("CLASS", "A", 3)]["span_end"] == 7
    assert got[("FUNC", "run", 5)]["parent_symbol"] == "A" and got[("FUNC", "run", 5)]["type"] == "str"
    assert got[("ARG", "args", 5)]["clue"] == "*args" and got[("CALL", "helper", 6)] and got[("COM", "note", 6)] and got[("PROP", "total", 6)]["is_definition"] == 1
    assert extract_file("./", "m.py", "python", "def (")[0] == []


@pytest.mark.parametrize(
    ("lang", "name", "code", "want"),
    [
        ("c", "a.c", '#include "x.h"\n#define MAX 4\nstatic int area(int side) {\n  return mul(side);\n}\n// the note word\n', {("IMP", "x.h"), ("MACRO", "MAX"), ("FUNC", "area"), ("CALL", "mul"), ("COM", "note")}),
        ("go", "a.go", 'package shop\nfunc Price(n int) int {\n  total := twice(n)\n  return total\n}\ntype Item struct {\n  name string\n}\n', {("NS", "shop"), ("FUNC", "Price"), ("VAR", "total"), ("CALL", "twice"), ("CLASS", "Item")}),
        ("rust", "a.rs", "use std::fmt;\nstruct Point { x: i32 }\nimpl Point {\n  fn norm(&self) -> i32 { self.total() }\n}\n", {("IMP", "std::fmt"), ("CLASS", "Point"), ("FUNC", "norm"), ("CALL", "total")}),
        ("typescript", "a.ts", "import { x } from 'lib';\nclass Shop {\n  price(n) {\n    return twice(n);\n  }\n}\n", {("CLASS", "Shop"), ("FUNC", "price"), ("CALL", "twice")}),
        ("php", "a.php", "<?php\nnamespace App;\nclass Shop {\n  function price($n) { $total = twice($n); }\n}\n", {("NS", "App"), ("CLASS", "Shop"), ("FUNC", "price"), ("VAR", "$total")}),
        ("perl", "a.pl", "package Shop;\nuse strict;\nsub price {\n  my $total = twice(1);\n}\n", {("NS", "Shop"), ("IMP", "strict"), ("FUNC", "price"), ("VAR", "$total")}),
    ],
)
def test_lexers(lang, name, code, want):
    rows, error = extract_file("./", name, lang, code)
    got = {(r["context"], r["full_symbol"]) for r in rows}
    assert not error and want <= got, want - got
    assert all(r["span_start"] for r in rows if r["context"] in ("FUNC", "CLASS"))


SHAPES = {
    ("c", "a.c"): ('/* A small tool */\n#include <stdio.h>\nstruct box {\n  char *label;\n};\nstatic int area(int side, char *name) {\n  unsigned long total = side;\n  return printf("wide", total);\n}\n', [
        ("IMP", "<stdio.h>", 2, 0, {}), ("PROP", "label", 4, 1, {"type": "char *", "parent_symbol": "box"}), ("FUNC", "area", 6, 1, {"type": "int", "modifier": "static"}), ("ARG", "side", 6, 1, {"type": "int"}),
        ("ARG", "name", 6, 1, {"type": "char *"}), ("VAR", "total", 7, 1, {"type": "unsigned long"}), ("CALL", "printf", 8, 0, {}), ("STR", "wide", 8, 0, {}), ("VAR", "total", 8, 0, {}), ("COM", "small", 1, 0, {}),
    ]),
    ("typescript", "a.ts"): ("class Shop {\n  owner: string;\n  #till: number;\n  constructor(owner: string) {\n    this.owner = owner;\n  }\n  static open(town: Town, n = 3): Shop {\n    return new Shop(`${this.owner} inn`);\n  }\n  #count(): number { return Math.round(this.#till); }\n}\n", [
        ("CLASS", "Shop", 1, 1, {}), ("PROP", "owner", 2, 0, {"type": "string"}), ("PROP", "#till", 3, 0, {"type": "number", "scope": "private"}), ("TYPE", "string", 4, 1, {}), ("ARG", "owner", 4, 1, {"type": "string"}),
        ("PROP", "owner", 5, 1, {"parent_symbol": "this"}), ("VAR", "owner", 5, 0, {}), ("FUNC", "open", 7, 1, {"type": "Shop", "modifier": "static"}), ("ARG", "town", 7, 1, {"type": "Town"}), ("ARG", "n", 7, 1, None), ("CALL", "Shop", 8, 0, {}),
        ("PROP", "owner", 8, 1, {"parent_symbol": "this"}), ("STR", "inn", 8, 0, {}), ("FUNC", "#count", 10, 1, {"type": "number", "scope": "private"}), ("CALL", "round", 10, 0, {"parent_symbol": "Math"}), ("PROP", "#till", 10, 1, {"parent_symbol": "this"}),
    ]),
    ("go", "a.go"): ("package shop\n\ntype Item struct {\n\tName string\n}\n\nfunc (s *Shop) Price(first, second int, tag string) (int, error) {\n\tvar total int\n\treturn total, nil\n}\n", [
        ("CLASS", "Item", 3, 1, {"scope": "public"}), ("PROP", "Name", 4, 1, {"type": "string", "parent_symbol": "Item"}), ("FUNC", "Price", 7, 1, {"scope": "public", "type": "(int, error)"}), ("ARG", "first", 7, 1, {"type": "int"}), ("ARG", "tag", 7, 1, {"type": "string"}), ("VAR", "total", 8, 1, {"type": "int"}),
    ]),
    ("rust", "a.rs"): ("pub struct Point { pub left: i32 }\nimpl Point {\n  pub fn norm(&self, scale: f64) -> f64 {\n    let sum: f64 = scale;\n    sum\n  }\n}\n", [
        ("PROP", "left", 1, 1, {"type": "i32", "parent_symbol": "Point", "scope": "public"}), ("FUNC", "norm", 3, 1, {"type": "f64", "scope": "public"}), ("ARG", "scale", 3, 1, {"type": "f64"}), ("VAR", "sum", 4, 1, {"type": "f64"}),
    ]),
    ("php", "a.php"): ("<?php\nclass Shop {\n  private ?int $count;\n  public static function price(int $amount, $rate = 2): float { return $this->twice($amount); }\n}\n", [
        ("PROP", "$count", 3, 1, {"type": "?int", "scope": "private"}), ("FUNC", "price", 4, 1, {"type": "float", "scope": "public", "modifier": "static"}), ("ARG", "$amount", 4, 1, {"type": "int"}), ("ARG", "$rate", 4, 1, {}), ("CALL", "twice", 4, 0, {"parent_symbol": "this"}),
    ]),
}


@pytest.mark.parametrize("file", list(SHAPES))
def test_lexer_attributes(file):
    """Types, access, modifiers, parents and which rows define."""
    code, want = SHAPES[file]
    rows, error = extract_file("./", file[1], file[0], code)
    assert not error
    have = {}
    for r in rows:
        have.setdefault((r["context"], r["full_symbol"], r["line"], r["is_definition"]), []).append(r)
    for context, name, line, defines, more in want:
        if more is None:  # too short to be indexed
            assert (context, name, line, defines) not in have
            continue
        found = have[context, name, line, defines]
        assert any(all(r[k] == v for k, v in more.items()) for r in found), (name, more, found)
    assert not any(r["full_symbol"] == "constructor" for r in rows)


def test_index_and_watch(spark, tmp_path):
    tree, store = tmp_path / "tree", IndexStore(spark, f"file://{tmp_path}/store")
    (tree / "sub").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    (tree / "a.py").write_text("def first():\n    pass\n")
    (tree / "sub" / "b.c").write_text("int second(void) {\n return 0;\n}\n")
    (tree / "node_modules" / "c.py").write_text("def hidden(): pass\n")
    assert {(r.directory, r.filename) for r in read_tree(spark, str(tree)).collect()} == {("./", "a.py"), ("./sub/", "b.c")}
    assert api.index(spark, str(tree), store).count() == 0
    symbols = lambda: {r.symbol for r in store.read().where("context = 'FUNC'").collect()}
    assert symbols() == {"first", "second"}
    check = f"file://{tmp_path}/check"
    query = api.watch(spark, str(tree), store, check, silence="500 milliseconds")
    try:
        query.processAllAvailable()
        (tree / "a.py").write_text("def changed():\n    pass\n")
        (tree / "d.py").write_text("def added():\n    pass\n")
        os.remove(tree / "sub" / "b.c")
        end = time.time() + 60
        while time.time() < end and symbols() != {"changed", "added"}:
            time.sleep(1)
        assert symbols() == {"changed", "added"}
        (tree / "a.py").write_text("def broken(:\n")
        query.processAllAvailable()
        time.sleep(3)
        query.processAllAvailable()
        assert symbols() == {"changed", "added"}  # what can't be parsed keeps its old rows
    finally:
        query.stop()


def test_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0, 9.0)] + [("b", v) for v in (2.0, 3.0, 5.0, 7.0, 8.0)], "arm string, v double")
    got = {r.arm: r for r in A.group_summary(df, "arm", "v").collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3) == (1.5, 2.0, 6.5)  # exclusive quartiles
    r = A.mann_whitney(df, "arm", "v", "a", "b").select("*", A.normal_p(A.F.col("z")).alias("p")).first()
    assert r.u == 8.0 and abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-6
    pooled = A.pool(spark.createDataFrame([(0.1, 0.1), (0.3, 0.2)], "effect double, se double")).first()
    assert abs(pooled.effect - 0.14) < 1e-9


def test_divided_calls(spark, sf_dir):
    """n parts of 100/n for each call, however many."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity").collect()
    want = Counter()
    for r in lines:
        if int(r.l_quantity) > 0:
            want[r.l_orderkey, round(100.0 / int(r.l_quantity), 6)] += int(r.l_quantity)
    assert Counter((r.l_orderkey, r.part) for r in registry.QUERIES["w14_divided_calls"](spark, sf_dir).collect()) == want


def test_bootstrap_draws(spark, sf_dir, monkeypatch):
    """The registered queries take the reference's 10,000 resamples."""
    taken = []
    for name in ("bootstrap_median_difference", "log_ratio"):
        operator = getattr(A, name)
        monkeypatch.setattr(A, name, lambda *a, f=operator, **b: taken.append(inspect.signature(f).bind(*a, **b).arguments["times"]) or f(*a, **b))
    assert all(registry.QUERIES[name](spark, sf_dir).count() for name in ("a31_bootstrap", "a32_log_ratio"))
    assert taken == [10_000, 10_000]


def exchanges(spark, df):
    """Runs a plan without adaptive changes: the records that each of its exchanges wrote."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        query = df.select("*")._jdf.queryExecution()  # planned anew
        query.toRdd().count()
        left, found = [query.executedPlan()], []
        while left:
            node = left.pop()
            left += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        return found
    finally:
        for k in off:
            spark.conf.unset(k)


def test_table_shuffles_class_words_alone(spark, sf_dir):
    """Lines and words stay where they are read; only words that open a class are dealt by document."""
    rows = O.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert exchanges(spark, rows) == [rows.where("context = 'CLASS'").count()]


def test_table_is_stored_unsorted(spark, sf_dir, monkeypatch):
    """A sort of all words spills where they don't fit into memory."""
    frame = type(spark.range(0))
    for name in ("sortWithinPartitions", "orderBy", "sort"):
        monkeypatch.setattr(frame, name, lambda *a, name=name: pytest.fail(name))
    assert O.occurrences(spark, f"{sf_dir}/").count() == O.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()


def test_class_spans_of_odd_lines(spark):
    """White space of every kind parts words, and a class ends before the next one or with the text."""
    text = "Open it\n\tab cd\nxx  yy\tzz, ww. vv\n,\n Next\t\n[,] qq rr ss\nLast"
    rows = O.from_documents(spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")).orderBy("seq").collect()
    assert [(r.symbol, r.line, r.seq % 10, r.context, r.span_end) for r in rows] == [
        ("open", 1, 1, "CLASS", 4), ("it", 1, 2, "VAR", None), ("ab", 2, 2, "VAR", None), ("cd", 2, 3, "COM", None), ("xx", 3, 1, "FUNC", 3), ("yy", 3, 2, "VAR", None), ("zz", 3, 3, "ARG", None), ("ww", 3, 4, "CALL", None), ("vv", 3, 5, "COM", None),
        ("next", 5, 1, "CLASS", 6), ("[]", 6, 1, "FUNC", 6), ("qq", 6, 2, "VAR", None), ("rr", 6, 3, "COM", None), ("ss", 6, 4, "VAR", None), ("last", 7, 1, "CLASS", 7),
    ]


def test_difference_joins_distinct_symbols(spark, monkeypatch):
    """No exchange gets a symbol once for each of its rows."""
    ci = rows_of(spark, [{"symbol": s, "context": c} for s, c in (("alpha", "VAR"), ("beta", "VAR"), ("beta", "ARG")) for _ in range(400)])
    monkeypatch.setattr(registry, "occurrences", lambda *_: ci)
    got = registry.QUERIES["u6_difference"](spark, "")
    assert [r.symbol for r in got.collect()] == ["alpha"]
    sent = exchanges(spark, got)
    assert sent and sum(sent) <= 3 * ci.rdd.getNumPartitions()


def test_quantiles_of_parts(spark):
    """Exact over many parts, with ties, null groups and single values; no aggregate or window holds a group's different values."""
    data = [("a", float((i * 7919) % 1009)) for i in range(3000)] + [("b", 5.0)] * 500 + [("c", 1.5), ("d", None)] + [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "arm string, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.arm: r for r in A.quantiles(df, ["arm"], "v", {"x": 0.0, "m": 0.5, "p": 0.9, "y": 1.0}, {"q": 0.25}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert set(got) == {"a", "b", "c", None}
    for arm, r in got.items():
        xs = sorted(v for a, v in data if a == arm and v is not None)
        for name, q in (("x", 0.0), ("m", 0.5), ("p", 0.9), ("y", 1.0)):
            at = q * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            assert abs(r[name] - (low + (high - low) * (at - math.floor(at)))) < 1e-9, (arm, name)
        if len(xs) > 1:
            assert r.q == pytest.approx(statistics.quantiles(xs, n=4)[0])
    plan = A.group_summary(df, "arm", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
