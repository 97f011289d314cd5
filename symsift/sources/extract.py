"""Symbols of source files: a syntax-tree extractor for Python, a lexer for the other languages.

The lexer knows comments, strings, definitions with their types, modifiers and
access, parameters, fields, imports, calls and members by pattern; it doesn't
know types of expressions, so its rows have less attributes than a full
parser's.  Definitions always carry a span, those of classes in every language.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from symsift.functions.text import NOISE_PATTERNS, PUNCTUATION, STOPWORDS, fold
from symsift.schema import SCHEMA
from symsift.storage import scratch

Row = dict
_CLEAN = re.compile(r"[^A-Za-z0-9_./:@#?&=+^$!~<>\[\]%-]")
_NOISE = re.compile("|".join(f"(?:{p})" for p in NOISE_PATTERNS))
KEYWORDS = {
    "c": "if else for while do switch case break continue return goto sizeof typedef struct union enum static const void int char long short unsigned signed float double extern inline volatile register default",
    "go": "if else for range switch case break continue return goto func type struct interface map chan go defer select package import var const default fallthrough nil",
    "rust": "if else for while loop match break continue return fn let mut pub impl trait struct enum use mod crate self super as in where ref move const static unsafe async await dyn type",
    "typescript": "if else for while do switch case break continue return function class interface extends implements import export from const let var new this typeof instanceof in of async await default try catch finally throw null undefined true false type enum",
    "php": "if else elseif for foreach while do switch case break continue return function class interface trait extends implements namespace use public private protected static const new echo null true false fn match abstract final",
    "perl": "if else elsif unless for foreach while until do last next redo return sub my our local use require package no undef",
    "python": "if else elif for while break continue return def class import from as with try except finally raise pass lambda yield global nonlocal assert del in is not and or none true false async await",
}
KEYWORD_SETS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}


def admitted(word: str, lang: str) -> bool:
    low = fold(word)
    return len(word) >= 2 and word not in PUNCTUATION and not word.isdigit() and low not in KEYWORD_SETS.get(lang, ()) and low not in STOPWORDS and not _NOISE.search(word)


class Collector:
    def __init__(self, directory: str, filename: str, lang: str):
        self.base = {"directory": directory, "filename": filename}
        self.lang = lang
        self.rows: list[Row] = []
        self.add(filename.rsplit(".", 1)[0], 1, "FILE", check=False)

    def add(self, name: str, line: int, context: str, check: bool = True, span: tuple[int, int, int, int] | None = None, **more) -> None:
        if not name or len(name.encode()) >= 512 or check and not admitted(name, self.lang):
            return
        key = fold(name)
        if context in ("VAR", "PROP") and len(key) > 1:
            key = key.removeprefix("$")
        if context in ("COM", "STR"):
            key = key.rstrip(".,!?:;")
        row = {"symbol": key, "line": line, "context": context, "full_symbol": name, "source_location": "{}:{} - {}:{}".format(*span) if span else ""}
        for c in ("parent_symbol", "scope", "namespace", "modifier", "clue", "type"):
            row[c] = str(more.get(c) or "")
        row["is_definition"] = int(bool(more.get("definition")))
        row["seq"] = len(self.rows)
        row["span_start"], row["span_end"] = (span[0], span[2]) if span else (None, None)
        self.rows.append(self.base | row)

    def words(self, text: str, line: int, context: str) -> None:
        for i, part in enumerate(text.split("\n")):
            for w in part.split():
                self.add(_CLEAN.sub("", w), line + i, context)


class _Python(ast.NodeVisitor):
    def __init__(self, out: Collector):
        self.out, self.owner, self.function = out, [], []

    def _span(self, n: ast.AST) -> tuple[int, int, int, int]:
        return n.lineno, n.col_offset, n.end_lineno, n.end_col_offset

    def _function(self, n, modifier: str = "") -> None:
        clue = ",".join("@" + ast.unparse(d) for d in n.decorator_list)
        self.out.add(n.name, n.lineno, "FUNC", False, self._span(n), definition=True, modifier=modifier, clue=clue, parent_symbol=self.owner[-1] if self.owner else "", type=ast.unparse(n.returns) if n.returns else "")
        a = n.args
        for arg, how in [*((x, "") for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]), *([(a.vararg, "*args")] if a.vararg else []), *([(a.kwarg, "**kwargs")] if a.kwarg else [])]:
            if arg.arg not in ("self", "cls"):
                self.out.add(arg.arg, arg.lineno, "ARG", definition=True, parent_symbol=n.name, clue=how, type=ast.unparse(arg.annotation) if arg.annotation else "")
        self.function.append(n.name)
        self.generic_visit(n)
        self.function.pop()

    def visit_FunctionDef(self, n):  # noqa: N802
        self._function(n)

    def visit_AsyncFunctionDef(self, n):  # noqa: N802
        self._function(n, "async")

    def visit_ClassDef(self, n):  # noqa: N802
        self.out.add(n.name, n.lineno, "CLASS", False, self._span(n), definition=True, parent_symbol=ast.unparse(n.bases[0]) if n.bases else "", clue=",".join("@" + ast.unparse(d) for d in n.decorator_list))
        self.owner.append(n.name)
        self.generic_visit(n)
        self.owner.pop()

    def _target(self, t: ast.AST, n: ast.AST, kind: str = "") -> None:
        if isinstance(t, ast.Name):
            self.out.add(t.id, t.lineno, "VAR", True, self._span(n), definition=True, type=kind)
        elif isinstance(t, ast.Attribute):
            self.out.add(t.attr, t.lineno, "PROP", False, self._span(n), definition=True, parent_symbol=ast.unparse(t.value), type=kind)
        elif isinstance(t, ast.Tuple | ast.List):
            for x in t.elts:
                self._target(x, n)
        else:
            self.visit(t)

    def visit_Assign(self, n):  # noqa: N802
        for t in n.targets:
            self._target(t, n)
        self.visit(n.value)

    def visit_AnnAssign(self, n):  # noqa: N802
        self._target(n.target, n, ast.unparse(n.annotation))
        if n.value:
            self.visit(n.value)

    def visit_NamedExpr(self, n):  # noqa: N802
        self.out.add(n.target.id, n.lineno, "VAR", definition=True, clue=":=")
        self.visit(n.value)

    def visit_Import(self, n):  # noqa: N802
        for a in n.names:
            self.out.add(a.asname or a.name, n.lineno, "IMP", False, clue=a.name if a.asname else "")

    def visit_ImportFrom(self, n):  # noqa: N802
        for a in n.names:
            self.out.add(a.asname or a.name, n.lineno, "IMP", False, clue=a.name if a.asname else "", namespace=n.module or "")

    def visit_Call(self, n):  # noqa: N802
        f = n.func
        name, parent = (f.id, "") if isinstance(f, ast.Name) else (f.attr, ast.unparse(f.value)) if isinstance(f, ast.Attribute) else ("", "")
        self.out.add(name, f.lineno, "CALL", parent_symbol=parent)
        for a in n.args:
            if isinstance(a, ast.Name):
                self.out.add(a.id, a.lineno, "ARG", clue=name)
            else:
                self.visit(a)
        for k in n.keywords:
            self.visit(k.value)
        if isinstance(f, ast.Attribute):
            self.visit(f.value)

    def visit_Name(self, n):  # noqa: N802
        self.out.add(n.id, n.lineno, "VAR")

    def visit_Attribute(self, n):  # noqa: N802
        self.out.add(n.attr, n.lineno, "PROP", parent_symbol=ast.unparse(n.value))
        self.visit(n.value)

    def visit_Lambda(self, n):  # noqa: N802
        self.out.add("<lambda>", n.lineno, "LAM", False, self._span(n), definition=True)
        self.generic_visit(n)

    def visit_ExceptHandler(self, n):  # noqa: N802
        if n.type:
            self.out.add(ast.unparse(n.type), n.lineno, "EXC")
        if n.name:
            self.out.add(n.name, n.lineno, "EXC", definition=True)
        for x in n.body:
            self.visit(x)

    def visit_Constant(self, n):  # noqa: N802
        if isinstance(n.value, str):
            self.out.words(n.value, n.lineno, "STR")


def python_rows(out: Collector, text: str) -> None:
    _Python(out).visit(ast.parse(text))
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            out.words(t.string.lstrip("#"), t.start[0], "COM")


_HASH, _SLASH = r"\#[^\n]*", r"//[^\n]*|/\*[\s\S]*?\*/"
_STRINGS = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`'
#: language -> comments, then definitions as (context, pattern with a group for the name)
GRAMMARS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "c": (_SLASH, (("FUNC", r"^(?P<before>[A-Za-z_][\w \t*]*?[\s*])(?P<name>\w+)\s*\((?P<params>[^;{}()]*)\)\s*\{"), ("VAR", r"^[ \t]*(?P<before>(?:(?:static|const|extern|unsigned|struct|volatile)\s+)*[A-Za-z_]\w*[ \t*]+)(?P<name>\w+)\s*(?=[=;\[])"), ("TYPE", r"\b(?:struct|union)\s+(\w+)\s*\{"), ("TYPE", r"\btypedef\b[^;{}]*?(\w+)\s*;"), ("ENUM", r"\benum\s+(\w+)\s*\{"), ("MACRO", r"^[ \t]*#[ \t]*define\s+(\w+)"), ("IMP", r"^[ \t]*#[ \t]*include\s+\"?(<[^>]+>|[^\"\s]+)"), ("LABEL", r"^(\w+):\s*$"), ("GOTO", r"\bgoto\s+(\w+)"))),
    "go": (_SLASH, (("NS", r"^package\s+(\w+)"), ("FUNC", r"^func\s+(?:\((?P<receiver>[^)]*)\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\((?P<params>[^()]*)\)(?P<after>[^\n{]*)\{"), ("CLASS", r"\btype\s+(\w+)\s+struct\s*\{"), ("IFACE", r"\btype\s+(\w+)\s+interface\s*\{"), ("TYPE", r"\btype\s+(\w+)\s+=?\s*(?!struct|interface)\w"), ("IMP", r"^(?:import\s+|\s+)(?:[\w.]+\s+)?\"([^\"]+)\"\s*$"), ("VAR", r"\b(?:var|const)\s+(?P<name>\w+)(?:[ \t]+(?P<type>[\w.*\[\]]+))?"), ("VAR", r"\b(\w+)\s*:="))),
    "rust": (_SLASH, (("FUNC", r"(?P<before>(?:\b(?:pub|async|unsafe|const)\b(?:\([^)]*\))?\s+)*)\bfn\s+(?P<name>\w+)(?:<[^>]*>)?\s*\((?P<params>[^()]*)\)(?P<after>[^;{]*)\{"), ("CLASS", r"\bstruct\s+(\w+)(?:<[^>]*>)?\s*\{?"), ("ENUM", r"\benum\s+(\w+)\s*[^;{]*\{"), ("TRAIT", r"\btrait\s+(\w+)[^;{]*\{"), ("CLASS", r"\bimpl\b(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)[^;{]*\{"), ("NS", r"\bmod\s+(\w+)"), ("IMP", r"\buse\s+([\w:]+)"), ("MACRO", r"\bmacro_rules!\s+(\w+)"), ("VAR", r"\blet\s+(?:mut\s+)?(?P<name>\w+)(?:\s*:\s*(?P<type>[^=;\n]+))?"), ("TYPE", r"\btype\s+(\w+)\s*="))),
    "typescript": (_SLASH, (("CLASS", r"\bclass\s+(\w+)[^{]*\{"), ("IFACE", r"\binterface\s+(\w+)[^{]*\{"), ("ENUM", r"\benum\s+(\w+)\s*\{"), ("TYPE", r"\btype\s+(\w+)\s*(?:<[^>]*>)?\s*="), ("FUNC", r"(?P<before>\b(?:async\s+)?)\bfunction\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^()]*)\)(?P<after>[^{;]*)\{"), ("FUNC", r"^[ \t]+(?P<before>(?:(?:public|private|protected|static|async|abstract|override|get|set)\s+)*)(?!(?:if|for|while|switch|catch|return|function)\b)(?P<name>#?\w+)\s*(?:<[^>]*>)?\((?P<params>[^()]*)\)(?P<after>[^{};\n]*)\{"), ("FUNC", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?P<before>async\s*)?\((?P<params>[^()]*)\)(?P<after>[^=\n]*)=>"), ("PROP", r"^[ \t]+(?P<before>(?:(?:public|private|protected|static|readonly|declare)\s+)*)(?P<name>#?\w+)[?!]?\s*:\s*(?P<type>[^=;(){}\n,]+?)\s*[;=]"), ("VAR", r"\b(?:const|let|var)\s+(?P<name>\w+)(?:\s*:\s*(?P<type>[^=;\n]+?)\s*(?=[=;]))?"), ("IMP", r"\bimport\b[^'\"\n]*?(\w+)[^'\"\n\w]*from"), ("EXP", r"\bexport\s+(?:default\s+)?(?:class|function|const|interface|type|enum)\s+(\w+)"))),
    "php": (_SLASH + "|" + _HASH, (("NS", r"^namespace\s+([\w\\]+)"), ("CLASS", r"\bclass\s+(\w+)[^{]*\{"), ("IFACE", r"\binterface\s+(\w+)[^{]*\{"), ("TRAIT", r"\btrait\s+(\w+)\s*\{"), ("ENUM", r"\benum\s+(\w+)[^{]*\{"), ("FUNC", r"(?P<before>(?:\b(?:public|private|protected|static|abstract|final)\s+)*)\bfunction\s+&?(?P<name>\w+)\s*\((?P<params>[^()]*)\)(?P<after>[^{;]*)\{"), ("PROP", r"(?P<before>\b(?:public|private|protected)\s+(?:static\s+|readonly\s+)*)(?:(?P<type>[?\w\\|]+)\s+)?(?P<name>\$\w+)"), ("IMP", r"^use\s+([\w\\]+)"), ("VAR", r"(\$\w+)\s*=[^=>]"), ("VAR", r"\bconst\s+(\w+)"))),
    "perl": (_HASH, (("NS", r"^package\s+([\w:]+)"), ("FUNC", r"^\s*sub\s+(\w+)[^{]*\{"), ("IMP", r"^\s*(?:use|require)\s+([\w:]+)"), ("VAR", r"\b(?:my|our|local)\s+([\$@%]\w+)"), ("LABEL", r"^(\w+):\s"))),
}
_DEFINES = {"FUNC", "CLASS", "IFACE", "TYPE", "ENUM", "TRAIT", "MACRO", "VAR", "NS", "LABEL"}
_ACCESS = ("public", "private", "protected")
_MODIFIERS = ("static", "inline", "extern", "async", "abstract", "final", "const", "unsafe", "readonly", "override", "volatile")
_NOT_TYPES = frozenset("return goto else case typedef break continue struct union enum".split())
_PREDEFINED = frozenset("string number boolean any void unknown never object symbol bigint".split())
#: how one parameter is written: groups name and, where it is there, type
_PARAMETERS = {
    "c": r"(?P<type>[A-Za-z_][\w\s*]*?[\s*])(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])*$",
    "go": r"(?P<name>\w+)(?:\s+(?P<type>\S.*))?$",
    "rust": r"(?:mut\s+)?(?P<name>[A-Za-z_]\w*)\s*:\s*(?P<type>.+)$",
    "typescript": r"(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?(?P<name>[\w$]+)\??\s*(?::\s*(?P<type>[^=]+?))?\s*(?:=.*)?$",
    "php": r"(?:(?:public|private|protected|readonly)\s+)*(?:(?P<type>[?\w\\|]+)\s+)?&?(?:\.\.\.)?(?P<name>\$\w+)\s*(?:=.*)?$",
}
#: how a field is written inside the braces of these definitions
_FIELDS = {
    "c": ("TYPE", r"^[ \t]*(?P<type>[A-Za-z_][\w \t*]*?[ \t*])(?P<name>\w+)\s*(?:\[[^\]]*\])*\s*;"),
    "go": ("CLASS", r"^[ \t]+(?P<name>\w+)[ \t]+(?P<type>[^\s`{}]+)[ \t]*$"),
    "rust": ("CLASS", r"(?:^|[{,])\s*(?P<before>(?:pub(?:\([^)]*\))?\s+)?)(?P<name>\w+)\s*:\s*(?P<type>[^,{}]+)"),
}


def _split_parameters(text: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of the parts between commas outside brackets."""
    depth = start = 0
    for i, c in enumerate(text + ","):
        if c == "," and depth == 0:
            part = text[start:i]
            if part.strip():
                yield start + len(part) - len(part.lstrip()), part.strip()
            start = i + 1
        depth += (c in "([{<") - (c in ")]}>")


def _parameters(lang: str, text: str) -> list[tuple[int, str, str]]:
    """(offset, name, type); in Go a type counts for the names before it."""
    out = []
    for at, part in _split_parameters(text):
        m = re.match(_PARAMETERS.get(lang, r"(?!)"), part, re.S)
        if m and m["name"] not in ("self", "void"):
            out.append((at + m.start("name"), m["name"], " ".join((m["type"] or "").split())))
    if lang == "go":
        kind = ""
        for i in range(len(out) - 1, -1, -1):
            at, name, own = out[i]
            kind = own or kind
            out[i] = (at, name, kind)
    return out


def _attributes(lang: str, context: str, m: re.Match) -> dict[str, str]:
    """type, scope and modifier of a definition, from what its match has around the name."""
    got = m.groupdict()
    name, before = m["name"] if "name" in got else m[1], (got.get("before") or "")
    words = re.sub(r"\([^)]*\)", "", before).replace("*", " * ").split()
    kind = got.get("type") or ""
    if lang == "c" and before:
        kind = " ".join(w for w in words if w not in _MODIFIERS)
    elif "after" in got:
        kind = re.sub(r"^\s*(?:->|:)?\s*", "", (got["after"] or "").split(" where ")[0])
    scope = next((w for w in words if w in _ACCESS), "")
    if name.startswith("#"):
        scope = "private"
    elif lang == "rust" and "pub" in words:
        scope = "public"
    elif lang == "go" and context in ("FUNC", "CLASS", "IFACE", "TYPE"):
        scope = "public" if name[:1].isupper() else "private"
    return {"type": " ".join(kind.split()), "scope": scope, "modifier": " ".join(w for w in words if w in _MODIFIERS)}


def _block_end(code: str, at: int) -> int:
    """Where the brace that is open at ``at`` closes; the place itself if none is."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return at + m.end()
    return at


def lexer_rows(out: Collector, text: str) -> None:
    comments, definitions = GRAMMARS[out.lang]
    keywords = KEYWORD_SETS[out.lang]
    line_of = [0]
    for m in re.finditer("\n", text):
        line_of.append(m.end())
    place = lambda at: (n := bisect.bisect_right(line_of, at), at - line_of[n - 1])

    def blank(m: re.Match) -> str:
        kind = "COM" if re.match(comments, m[0]) else "STR"
        include = kind == "STR" and re.search(r"(#\s*include\s*|import\s+|from\s+|^\s+)$", text[line_of[place(m.start())[0] - 1] : m.start()])
        words = re.sub(r"^(//+|/\*+|#+|['\"`])|(\*/|['\"`])$", "", m[0])
        if m[0][0] == "`" and out.lang == "typescript":  # what a template string computes is code
            out.words(re.sub(r"\$\{[^}]*\}", " ", words), place(m.start())[0], kind)
            return "".join(x if x.startswith("${") else re.sub(r"[^\n]", " ", x) for x in re.split(r"(\$\{[^}]*\})", m[0])).replace("${", "  ").replace("}", " ")
        out.words(words, place(m.start())[0], kind)
        return m[0] if include else re.sub(r"[^\n]", " ", m[0])

    code = re.sub(f"{comments}|{_STRINGS}", blank, text)
    seen: set[tuple[int, str]] = set()
    named: set[int] = set()

    def add(context: str, m: re.Match, **more) -> None:
        which = "name" if "name" in m.groupdict() else 1
        name, at = m[which], m.start(which)
        if (at, context) in seen or at in named and context in ("VAR", "PROP") or name in keywords:
            return
        seen.add((at, context))
        named.add(at)
        brace = m.end() - 1 if m[0].endswith("{") else None
        stop = _block_end(code, brace) if brace is not None else m.end()
        span = (*place(at), *place(stop)) if context in _DEFINES else None
        more = _attributes(out.lang, context, m) | more
        if context != "FUNC" or name != "constructor":
            out.add(name, place(at)[0], context, context != "IMP", span, definition=more.pop("definition", context in _DEFINES), **more)
        params = m.groupdict().get("params")
        for offset, arg, kind in _parameters(out.lang, params) if params else ():
            where = m.start("params") + offset
            named.add(where)
            if out.lang == "typescript" and kind in _PREDEFINED:
                out.add(kind, place(where)[0], "TYPE", False, definition=True)
                named.update(x.start() + where for x in re.finditer(rf"\b{kind}\b", code[where : where + len(arg) + len(kind) + 8]))
            out.add(arg, place(where)[0], "ARG", True, (*place(where), *place(where + len(arg))), definition=True, type=kind)
        holder, field = _FIELDS.get(out.lang, ("", ""))
        if context == holder and brace is not None:
            for f in re.finditer(field, code[brace:stop], re.M):
                where = brace + f.start("name")
                if f["name"] not in keywords and where not in named:
                    named.add(where)
                    out.add(f["name"], place(where)[0], "PROP", False, (*place(where), *place(where + len(f["name"]))), definition=True, parent_symbol=name, **{k: v for k, v in _attributes(out.lang, "PROP", f).items() if k != "type"}, type=" ".join(f["type"].split()))

    holder = _FIELDS.get(out.lang, ("",))[0]
    for context, pattern in sorted(definitions, key=lambda d: d[0] != holder):  # fields are told from variables by their braces
        for m in re.finditer(pattern, code, re.M):
            first = (m.groupdict().get("before") or "").split()
            if out.lang == "c" and context == "VAR" and (not first or first[0] in _NOT_TYPES):
                continue
            add(context, m, **({"definition": out.lang != "typescript"} if context == "PROP" else {}))
    for m in re.finditer(r"((?:[\$@%]|#(?=\w))?\b[A-Za-z_]\w*)(\s*\()?", code):
        if m.start(1) in named or m[1] in keywords or m[1].startswith("#") and out.lang != "typescript":
            continue
        before = re.search(r"(\w+)\s*(?:\?\.|\.|->|::)\s*$", code[max(0, m.start() - 80) : m.start()])
        chained = re.search(r"[)\]]\s*(?:\?\.|\.|->|::)\s*$", code[max(0, m.start() - 80) : m.start()])
        context = "CALL" if m[2] else "PROP" if before or chained else "VAR"
        own = bool(before and before[1] in ("this", "$this") and context == "PROP")
        out.add(m[1], place(m.start(1))[0], context, parent_symbol=before[1] if before else "", definition=own)


EXTRACTORS: dict[str, Callable[[Collector, str], None]] = {"python": python_rows} | dict.fromkeys(GRAMMARS, lexer_rows)


def register_language(lang: str, extract: Callable[[Collector, str], None]) -> None:
    """A new language, or another extractor for a known one."""
    EXTRACTORS[lang] = extract


def extract_file(directory: str, filename: str, lang: str, text: str) -> tuple[list[Row], str]:
    """(rows, error); a file that can't be parsed has no rows."""
    out = Collector(directory, filename, lang)
    try:
        EXTRACTORS[lang](out, text or "")
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        return [], f"{type(e).__name__}: {e}"
    return out.rows, ""


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with lang, failed files with error) of directory, filename, lang, content.

    Every file is parsed once: both are read from one stored table.
    """
    names = [*SCHEMA.names, "lang", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                rows, error = extract_file(f.directory, f.filename, f.lang, f.content)
                if error:
                    rows = [dict.fromkeys(SCHEMA.names) | {"directory": f.directory, "filename": f.filename}]
                out = pd.DataFrame(rows, columns=SCHEMA.names).astype({c: "Int64" for c in ("line", "is_definition", "seq", "span_start", "span_end")})
                yield out.assign(lang=f.lang, error=error)[names]

    every = files.select("directory", "filename", "lang", "content").mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMA) + ", lang string, error string")
    path = scratch(files.sparkSession, "extracted")
    every.write.parquet(path)
    every = files.sparkSession.read.schema(every.schema).parquet(path)
    return every.where("error = ''").drop("error"), every.where("error <> ''").select("directory", "filename", "error")
