"""Secret scans with an incremental blob ledger (operator 1), DataFrame functions only.

Every version of every text is a blob, addressed by its SHA-256.  The ledger
holds one row for each (blob, rules version) that was ever scanned, with the
spans found.  A scan looks at the blobs whose pair is not in the ledger, each
once however many paths carry it, and joins the findings back to all paths.

Null texts count as empty and have no findings; repeated rows are paths of one
blob; ids may be null or repeated; other columns are ignored.  Positions are in
code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if ``group`` has ``least`` characters or more.

    Later rules come after earlier ones at the same start.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token")))
RULES = (
    Rule("assign", rf"""({WORDS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # the runs of 16 or more; shorter ones fail anyway and would only fill arrays
)
SPANS = "array<struct<start:int,rule:int,stop:int>>"


def version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


STEP = 64  # values that one growing array holds while running values are made
STRETCH = 4096  # code points that a substring has to look through


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is, an expression inside a lambda isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, join) -> Column:
    """What ``join`` makes of the values before each value, from ``zero`` on.

    In two levels, so that no array grows with all values: totals of stretches of
    ``STEP`` values first, then inside each stretch from what is before it.
    """
    nothing = F.array().cast("array<int>")

    def before(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.struct(start.alias("at"), nothing.alias("out")), lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return grown["out"]

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: F.slice(v, i * STEP + 1, STEP))
    inside = lambda parts: F.flatten(F.zip_with(parts, before(F.transform(parts, lambda p: F.aggregate(p, zero, join)), zero), before))
    return bound(values, lambda v: F.when(F.size(v) == 0, nothing).otherwise(bound(cut(v), inside)))


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule: the pieces between matches and the matches give the positions."""
    pattern = F.lit(rule.pattern)
    pieces, all_ = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.transform(all_ if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g))

    def spans(sizes: Column) -> Column:
        gaps = F.slice(F.transform(pieces, lambda p: F.length(p)), F.lit(1), F.size(sizes))
        steps = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))

        def placed(s: Column) -> Column:
            at = running(F.transform(s, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, x: a + x)
            start = lambda a, x: F.struct((a + x["gap"]).alias("start"), F.lit(number).alias("rule"), (a + x["gap"] + x["size"]).alias("stop"))
            return F.zip_with(at, s, start)

        return F.array_compact(F.zip_with(bound(steps, placed), checked, lambda s, n: F.when(n >= rule.least, s)))

    found = bound(F.transform(all_, lambda m: F.length(m)), spans)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    return F.array_sort(F.concat(*(rule_spans(text, i, r) for i, r in enumerate(rules))))


def shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then rule, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans, which come in order and may overlap, replaced: one that begins inside another goes with it."""

    def of(parts: Column, s: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:  # characters a to b, from the stretches they lie in
            i, j = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
            head, tail = F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, j), F.lit(""))
            several = F.concat(F.substring(head, a - i * STRETCH + 1, F.lit(STRETCH)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), b - j * STRETCH))
            return F.when(i == j, F.substring(head, a - i * STRETCH + 1, b - a)).otherwise(several)

        reach = running(F.transform(s, lambda x: x["stop"]), F.lit(0), lambda a, x: F.greatest(a, x))
        kept = F.zip_with(s, reach, lambda x, a: F.when(x["start"] >= a, F.concat(piece(a, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(s, lambda x: x["stop"]))
        return F.concat(F.array_join(kept, ""), piece(last, F.length(text)))

    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(bound(stretches, lambda parts: bound(spans, lambda s: of(parts, s))))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings, scanned): id_col, blob, spans for every row of docs, and the new ledger rows blob, rules, spans."""
    blob_of = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    paths = docs.select(F.col(id_col).alias("id"), blob_of.alias("blob"))
    blobs = docs.select(blob_of.alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    seen = None
    if ledger is not None:
        seen = ledger.where(F.col("rules") == version(rules)).select("blob", F.col("spans").cast(SPANS).alias("spans"))
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    scanned = save(blobs.dropDuplicates(["blob"]).select("blob", F.lit(version(rules)).alias("rules"), all_spans(F.col("body"), rules).alias("spans")), "scanned")
    known = scanned.select("blob", "spans")
    if seen is not None:
        known = known.unionByName(seen.dropDuplicates(["blob"]))
    hits = known.where(F.size("spans") > 0)
    out = paths.join(hits, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return out, scanned


def query(spark, sf_dir: str) -> DataFrame:
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["rule"] < 3), RULES), 256).alias("base_sha256"), shown(F.col("spans"), RULES).alias("spans"),
    )


def _sql_rule(i: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(body, '{p}')) + 1), lambda i: {{
        'start': list_sum(list_transform(string_split_regex(body, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(body, '{p}')[1:i-1], lambda x: length(x))), 0),
        'rule': {i}, 'size': length(regexp_extract_all(body, '{p}')[i]), 'checked': length(regexp_extract_all(body, '{p}', {rule.group})[i])}}), lambda s: s.checked >= {rule.least})"""


_SHOW = "array_to_string(list_transform(spans, lambda s: ['assign', 'access', 'hex'][s.rule + 1] || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.size AS BIGINT)), ',')"
ORACLE = f"""
SELECT doc_id, CAST(len(list_filter(spans, lambda s: s.rule = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(spans, lambda s: s.rule = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(spans, lambda s: s.rule = 2)) AS BIGINT) AS n_hex, sha256({_SHOW}) AS base_sha256, {_SHOW} AS spans
FROM (
    SELECT doc_id, list_sort(list_concat({", ".join(_sql_rule(i, r) for i, r in enumerate(RULES))})) AS spans
    FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
)
"""
