"""What a search asks for, and the command language it can be written in."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, replace

from symsift.functions.text import split_alternation, split_qualified
from symsift.schema import COLUMNS, EXT_COLUMNS, NOISE, context_of


class CommandError(ValueError):
    """A command that can't be read; the message says why."""


@dataclass(frozen=True)
class QuerySpec:
    patterns: tuple[str, ...] = ("%",)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    meta: dict[str, tuple[str, ...]] = field(default_factory=dict)
    show: tuple[str, ...] = ()
    definition: tuple[int, ...] = ()
    parent_type: tuple[str, ...] = ()
    lines: tuple[int, int] | None = None
    within: tuple[str, ...] = ()
    together: int | None = None  # 0: on the same line; n: within n lines
    mode: str = "set"  # of proximity: set, native or web
    limit: int = 0
    limit_per_file: int = 0
    columns: tuple[str, ...] = ()
    expand: bool = False
    before: int = 0
    after: int = 0
    files_only: bool = False
    toc: bool = False
    verbose: bool = False
    full: bool = False
    raw: bool = False
    quiet: bool = False
    qualified: tuple[str, str] | None = None

    def contexts(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(include, exclude); an include list makes the exclude list void."""
        return (self.include, ()) if self.include else ((), self.exclude)

    def has_filters(self) -> bool:
        """Whether a filter is on; lines, containment and parent types are scopes and don't count."""
        return bool(self.include or self.exclude or self.files or any(self.meta.values()) or self.definition)


_LISTS = {"-i": "include", "--include-context": "include", "-x": "exclude", "--exclude-context": "exclude", "-f": "files", "--file": "files", "-w": "within", "--within": "within", "--parent-type": "parent_type", "--columns": "columns"}
_META = {f"-{c.flag}": c.name for c in EXT_COLUMNS if c.kind == "string"} | {"--parent": "parent_symbol", "--scope": "scope", "--namespace": "namespace", "--modifier": "modifier", "--clue": "clue", "--type": "type"}
_SWITCHES = {"--files": "files_only", "--toc": "toc", "-v": "verbose", "--verbose": "verbose", "--full": "full", "--raw": "raw", "-q": "quiet", "--quiet": "quiet", "-e": "expand", "--expand": "expand"}
_NUMBERS = {"-l": "limit", "--limit": "limit", "-lpf": "limit_per_file", "--limit-per-file": "limit_per_file"}
#: switches that a table of contents can't go with
_NOT_TOC = ("within", "together", "parent_type", "lines", "expand", "columns", "files_only", "raw", "verbose")
DEFAULT_CONTEXT_LINES, MOST_CONTEXT_LINES = 3, 100


def parse_range(text: str) -> tuple[int, int]:
    a, dash, b = text.partition("-")
    if not a.isdigit() or dash and not b.isdigit() or int(a) < 1 or dash and int(b) < int(a):
        raise CommandError(f"not a line or range of lines: {text}")
    return int(a), int(b) if dash else int(a)


def contexts_of(values: list[str], noise: bool) -> tuple[str, ...]:
    out: list[str] = []
    for v in values:
        if "," in v:
            raise CommandError("contexts are separated by blanks, not commas")
        try:
            out += NOISE if noise and v.lower() == "noise" else (context_of(v),)
        except ValueError as e:
            raise CommandError(str(e)) from e
    return tuple(dict.fromkeys(out))


def parse_command(command: str | list[str], defaults: QuerySpec | None = None) -> QuerySpec:
    """A command line to a spec.  Flags with several values read up to the next flag."""
    words = shlex.split(command) if isinstance(command, str) else list(command)
    spec: dict = {}
    patterns: list[str] = []
    meta: dict[str, tuple[str, ...]] = {}
    show: list[str] = []
    definition: list[int] = []
    i = 0

    def values() -> list[str]:
        nonlocal i
        out = []
        while i + 1 < len(words) and not (words[i + 1].startswith("-") and len(words[i + 1]) > 1):
            i += 1
            out.append(words[i])
        return out

    while i < len(words):
        w = words[i]
        if w in _LISTS:
            got = values()
            if not got:
                raise CommandError(f"{w} needs a value")
            name = _LISTS[w]
            if name in ("include", "exclude"):
                got = contexts_of(got, name == "exclude")
            if name == "columns":
                got = [c for v in got for c in v.split(",") if c]
            spec[name] = (*spec.get(name, ()), *got)
        elif w in _META:
            got = values()
            show.append(_META[w])
            if got:
                meta[_META[w]] = (*meta.get(_META[w], ()), *got)
        elif w in ("-d", "--definition", "--def", "--usage"):
            got = values() if w in ("-d", "--definition") else ["1" if w == "--def" else "0"]
            if any(v not in ("0", "1") for v in got):
                raise CommandError(f"{w} takes 0 or 1")
            show.append("is_definition")
            definition += [int(v) for v in got]
        elif w in _SWITCHES:
            spec[_SWITCHES[w]] = True
        elif w == "--compact":
            spec["full"] = False
        elif w in _NUMBERS:
            got = values()
            if len(got) != 1 or not got[0].isdigit():
                raise CommandError(f"{w} needs a number")
            spec[_NUMBERS[w]] = int(got[0])
        elif w == "--lines":
            got = values()
            if len(got) != 1:
                raise CommandError("--lines needs a line or a range")
            spec["lines"] = parse_range(got[0])
        elif w in ("--and", "--same-line"):
            got = values()
            if got and not got[0].isdigit():
                raise CommandError(f"{w} takes a number of lines")
            spec["together"] = int(got[0]) if got else 0
        elif w in ("-A", "-B", "-C"):
            got = values()
            n = int(got[0]) if got and got[0].isdigit() else DEFAULT_CONTEXT_LINES
            if n > MOST_CONTEXT_LINES:
                raise CommandError(f"{w}: at most {MOST_CONTEXT_LINES} lines")
            spec |= {"before": n} if w == "-B" else {"after": n} if w == "-A" else {"before": n, "after": n}
        elif w.startswith("-") and len(w) > 1 and not w.startswith("\\"):
            raise CommandError(f"unknown flag: {w}")
        else:
            if " " in w:
                raise CommandError("a pattern has no blanks; give the words as patterns with --and")
            patterns += split_alternation(w[1:] if w.startswith("\\-") else w)
        i += 1
    base = defaults or QuerySpec()
    if show:
        spec["show"] = tuple(dict.fromkeys(show))
    if meta:
        spec["meta"] = meta
    if definition:
        spec["definition"] = tuple(dict.fromkeys(definition))
    if patterns:
        spec["patterns"] = tuple(patterns)
        if len(patterns) == 1 and not (meta.get("parent_symbol") or meta.get("namespace")):
            spec["qualified"] = split_qualified(patterns[0])
    out = replace(base, **spec)
    if out.together is not None and len(out.patterns) < 2:
        raise CommandError("--and needs two patterns or more")
    if out.toc and (bad := [n for n in _NOT_TOC if getattr(out, n) not in (None, (), False)] + list(out.meta)):
        raise CommandError(f"--toc can't go with {', '.join(bad)}")
    return out


def defaults_from_config(text: str, section: str, given: list[str]) -> list[str]:
    """Flags of a section of a configuration text that the command line doesn't give."""
    out: list[str] = []
    here = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            here = line == f"[{section}]"
        elif here and line and not line.startswith("#"):
            words = shlex.split(line)
            if words[0] not in given:
                out += words
    return out


def default_columns(spec: QuerySpec) -> list[str]:
    """The projection: all, the ones named, or line, symbol, what is filtered or shown, context."""
    from symsift.schema import column_of

    every = [n for n, _ in COLUMNS]
    if spec.columns:
        return every if spec.columns == ("all",) else [column_of(c) for c in spec.columns]
    if spec.verbose:
        return ["line", "symbol", *(c.name for c in EXT_COLUMNS), "context"]
    used = [c.name for c in EXT_COLUMNS if c.name in spec.show or spec.meta.get(c.name)]
    return ["line", "symbol", *used, "context"]
