"""Results as text, streamed row by row."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame

from symsift import __version__
from symsift.operators import search as S
from symsift.operators import toc as C
from symsift.plans.spec import QuerySpec, default_columns
from symsift.schema import CONTEXTS, EXT_COLUMNS

TITLES = {"line": "LINE", "symbol": "SYM", "context": "CTX"} | {c.name: c.title for c in EXT_COLUMNS}


def table_lines(ci: DataFrame, spec: QuerySpec) -> Iterator[str]:
    """Rows under their files, columns as wide as their contents; a pass for the widths, then one for the rows."""
    columns = [c for c in default_columns(spec) if c not in S.FILE]
    rows = S.limited(S.select_rows(ci, spec), spec)
    most = S.widths(rows, columns).first()
    size = {c: max(len(TITLES.get(c, c.upper())), most[c] or 0) for c in columns}
    yield "  ".join(TITLES.get(c, c.upper()).ljust(size[c]) for c in columns).rstrip()
    last = None
    for r in rows.select(*S.FILE, *columns).toLocalIterator():
        path = r["directory"] + r["filename"]
        if path != last:
            yield f"\n{path}"
            last = path
        show = lambda c, v: CONTEXTS[v] if spec.full and c == "context" else "" if v is None else str(v)
        yield "  ".join(show(c, r[c]).ljust(size[c]) for c in columns).rstrip()


def footer(ci: DataFrame, spec: QuerySpec) -> list[str]:
    """How many rows there are, and by context if not all are shown."""
    rows = S.select_rows(ci, spec)
    per = S.breakdown(rows).collect()
    total = sum(r["n"] for r in per)
    out = [f"{total} matches"]
    if spec.limit and total > spec.limit:
        out = [f"{spec.limit} of {total} matches", ", ".join(f"{r['context']} {r['n']}" for r in per)]
    return out


def toc_lines(cx: DataFrame, spec: QuerySpec) -> Iterator[str]:
    for r in C.toc(cx, spec).toLocalIterator():
        yield r["directory"] + r["filename"]
        if r["imports"]:
            yield f"  imports: {r['imports']}"
        for section in ("class", "func", "enum", "type", "macro"):
            if r[section]:
                yield f"  {section}"
                for e in r[section]:
                    yield "    " + e["full_symbol"] + " " + "." * max(3, r["align"] - len(e["full_symbol"])) + f" {e['start_line']}"


def source_lines(ci: DataFrame, lines: DataFrame, spec: QuerySpec) -> Iterator[str]:
    """The source of a result's rows; with ``raw`` nothing but the text."""
    rows = S.limited(S.select_rows(ci, spec), spec)
    last = None
    for r in C.expand(rows, lines, spec.before, spec.after, spec.expand).toLocalIterator():
        if spec.raw:
            yield r["text"]
            continue
        if (at := (r["directory"], r["filename"], r["seq"])) != last:
            yield f"\n{r['directory']}{r['filename']}: {r['symbol']}"
            last = at
        yield f"{r['line_no']:6} {r['text']}"


def web_table(ci: DataFrame, spec: QuerySpec) -> Iterator[str]:
    """A result as an HTML table, row by row."""
    columns = [c for c in default_columns(spec) if c not in S.FILE]
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    yield "<table><tr>" + cell("th", "FILE") + "".join(cell("th", TITLES.get(c, c.upper())) for c in columns) + "</tr>"
    found = False
    for r in S.limited(S.select_rows(ci, spec), spec).select(*S.FILE, *columns).toLocalIterator():
        found = True
        yield "<tr>" + cell("td", r["directory"] + r["filename"]) + "".join(cell("td", r[c]) for c in columns) + "</tr>"
    yield "</table>" if found else "</table><p>No results</p>"


def web_breakdown(ci: DataFrame, spec: QuerySpec) -> str:
    return "<ul>" + "".join(f"<li>{html.escape(r['context'])} {r['n']}</li>" for r in S.breakdown(S.select_rows(ci, spec)).collect()) + "</ul>"


def debug(ci: DataFrame, spec: QuerySpec) -> str:
    """The plan that a command runs."""
    return S.search(ci, spec)._jdf.queryExecution().toString()


def usage() -> list[str]:
    """Every flag a command can have."""
    from symsift.plans import spec as P

    flags = [*P._LISTS, *P._META, *P._SWITCHES, *P._NUMBERS, "-d", "--def", "--usage", "--lines", "--and", "-A", "-B", "-C"]
    return [f"symsift {__version__}: PATTERN ... [flags]", "  " + " ".join(sorted(dict.fromkeys(flags)))]


def list_types() -> list[str]:
    return [f"{k:6} {v.lower()}" for k, v in CONTEXTS.items()]
