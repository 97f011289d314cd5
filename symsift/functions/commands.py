"""Text of commands, outputs, labels and SQL: what analyses of tool use look at."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsift.functions.text import NOISE_PATTERNS, STOPWORDS, admitted, fold_col

# commands
_SEGMENT = r"""(?:'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|[^;\n|&'"]++)++"""
SEARCHERS = ("grep", "rg", "ag", "ack")
#: programs that only shorten or reshape what another one printed
FILTERS = ("echo", "head", "tail", "less", "more", "wc", "sort", "uniq", "cut", "tr", "column", "nl", "fold")
OWN = "symsift"


def segments(command: Column) -> Column:
    """The parts of a shell command between ``;``, ``|``, ``&`` and line ends outside quotes; blank ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(command, F.lit(_SEGMENT), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def program(segment: Column) -> Column:
    """The word a segment runs, after assignments to variables; null if there is none."""
    got = F.regexp_extract(F.trim(segment), r"^(?:\w+=\S+\s+)*(\S+)", 1)
    return F.when(got != "", got)


def programs(command: Column) -> Column:
    return F.array_compact(F.transform(segments(command), program))


def edits(segment: Column) -> Column:
    """Whether a stream editor writes its file in place."""
    return segment.rlike(r"\s(-[a-zA-Z]*i|--in-place)")


def tool_kind(segment: Column, own: str = OWN) -> Column:
    """own, search, cat, or read (a stream editor that prints); null for any other program."""
    p = program(segment)
    return F.when(p == own, "own").when(p.isin(*SEARCHERS), "search").when(p == "cat", "cat").when((p == "sed") & ~edits(segment), "read")


def action_tool(command: Column, own: str = OWN) -> Column:
    """The one kind of tool a command uses, ``mixed`` for several, null for none."""
    kinds = F.array_distinct(F.array_compact(F.transform(segments(command), lambda s: tool_kind(s, own))))
    return F.when(F.size(kinds) > 1, "mixed").when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def only_tool(command: Column, kind: str, own: str = OWN) -> Column:
    """Whether everything a command prints comes from one kind of tool, through filters at most."""
    parts = F.transform(segments(command), lambda s: F.struct(F.coalesce(tool_kind(s, own), F.lit("")).alias("kind"), F.coalesce(program(s), F.lit("echo")).alias("program")))
    return F.exists(parts, lambda p: p["kind"] == kind) & F.forall(parts, lambda p: (p["kind"] == kind) | p["program"].isin(*FILTERS))


def sub_commands(command: Column, own: str = OWN) -> Column:
    """The segments that run one program."""
    return F.filter(segments(command), lambda s: program(s) == own)


def pipes(command: Column) -> Column:
    """How many single pipes stand outside quotes."""
    bare = F.regexp_replace(command, r"""'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|\|\|""", " ")
    return F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit("")))


def pattern_traits(sub_command: Column) -> dict[str, Column]:
    """Habits of other tools in a search command: dotted names, quoted phrases, absolute paths, alternations, flags."""
    quoted = F.regexp_extract(sub_command, r"""['"]([^'"]*)['"]""", 1)
    return {
        "dotted": sub_command.rlike(r"\s[A-Za-z_]\w*\.[A-Za-z_]\w*(\s|$)"), "phrase": quoted.rlike(r"\S\s+\S"), "absolute": sub_command.rlike(r"\s(-f|--file)\s+/"),
        "alternation": sub_command.rlike(r"\\?\|"), "parent": sub_command.rlike(r"\s(-p|--parent)(\s|$)"), "verbose": sub_command.rlike(r"\s(-v|--verbose)(\s|$)"),
    }


# outputs
def result_count(output: Column) -> Column:
    """How many matches an output reports: its footer, else its numbered rows, else 0 if it says that nothing was found, else null."""
    footer = F.regexp_extract(output, r"(?m)^(?:\d+ of )?(\d+) match(?:es)?$", 1)
    rows = F.regexp_count(output, F.lit(r"(?m)^\d+\s{2,}\S"))
    return F.when(footer != "", footer.cast("int")).when(rows > 0, rows).when(output.rlike("(?i)no (results|matches)"), 0)


def miss_kind(output: Column) -> Column:
    """Why a search found nothing: filtered, not_indexed, absent or other; empty for a hit or another output."""
    why = F.when(output.rlike("(?i)without (that|the) filter|excluded by"), "filtered").when(output.rlike("(?i)not indexed"), "not_indexed").when(output.rlike("(?i)no (symbol|definition) "), "absent").otherwise("other")
    return F.when(F.coalesce(result_count(output) == 0, F.lit(False)), why).otherwise("")


def return_code(output: Column) -> Column:
    got = F.regexp_extract(output, r"return_?code[^\w-]+(-?\d+)", 1)
    return F.when(got != "", got.cast("int"))


# names and labels
def short_label(instance: Column) -> Column:
    """What stands between the first ``__`` and the next dash, in lower case; the whole name has no prefix to drop."""
    tail = F.regexp_replace(instance, r"^(?s).*?__", "")
    return F.lower(F.regexp_extract(tail, r"^(?s)[^-]*", 0))


def family(model: Column, families: Sequence[str]) -> Column:
    """The first of the families whose name is in a model's, else the model."""
    out = model
    for f in reversed(families):
        out = F.when(F.lower(model).contains(f), f).otherwise(out)
    return out


def normal_id(instance: Column) -> Column:
    """An instance without its version suffix."""
    return F.regexp_replace(F.coalesce(instance, F.lit("")), r"-v[0-9a-z.]+$", "")


def test_file(entry: Column) -> Column:
    """The file of a test's name: before `` | `` or ``::``, else the name itself."""
    return F.trim(F.regexp_extract(entry, r"^(?s)(.*?)( \| |::|\z)", 1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def repr_list(text: pd.Series) -> pd.Series:
    """A list written as a literal of Python; empty if it is none."""

    def one(t: str | None) -> list[str]:
        try:
            got = ast.literal_eval(t or "[]")
        except (ValueError, SyntaxError):
            return []
        return [str(x) for x in got] if isinstance(got, list | tuple) else []

    return text.map(one)


def parse_open_range(text: str) -> tuple[int | None, int | None]:
    """``4-6``, ``4``, ``4-`` or ``-6``."""
    low, dash, high = text.strip().partition("-")
    if not dash:
        return int(low), int(low)
    return int(low) if low else None, int(high) if high else None


def in_range(value: Column, text: str) -> Column:
    low, high = parse_open_range(text)
    return (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)


def duration(seconds: Column) -> Column:
    """``XmYYs``"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60)


# words and queries
def filter_reason(word: Column, keywords: Sequence[str] = ()) -> Column:
    """Why a word isn't indexed: short, number, stopword, keyword or pattern; ``valid`` if it is."""
    low = fold_col(word)
    return (
        F.when(F.length(word) < 2, "short").when(word.rlike("^[0-9]+$"), "number").when(admitted(word, tuple(keywords), STOPWORDS, NOISE_PATTERNS), "valid")
        .when(low.isin(*STOPWORDS), "stopword").when(low.isin(*keywords), "keyword").otherwise("pattern")
    )


def plural(word: str) -> str:
    return word + ("es" if word == "match" else "s")


def widened(command: str, pattern: str) -> str:
    """A command with a pattern, where it stands as a word, made a search for what contains it."""
    return re.sub(rf"(?<!\S){re.escape(pattern)}(?!\S)", lambda m: f"*{m[0]}*", command, count=1) if pattern else command


def tail_clause(sql: str) -> int:
    """Where the outer GROUP BY, ORDER BY or LIMIT of a query begins; -1 if it has none.  Strings and brackets are passed over."""
    depth = 0
    for m in re.finditer(r"'(?:[^']|'')*(?:'|$)|[()]|(?:GROUP BY|ORDER BY|LIMIT)", sql):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth = max(0, depth - 1)
        elif m[0][0] != "'" and depth == 0:
            return m.start()
    return -1


def with_clause(sql: str, clause: str) -> str:
    """A query with one more condition before its tail clause."""
    at = tail_clause(sql)
    if not clause:
        return sql
    return sql + clause if at < 0 else f"{sql[:at]}{clause} {sql[at:]}"
