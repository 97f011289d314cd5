"""The occurrence table: one wide row per symbol occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnDef:
    """An optional attribute.  A new entry gives a field, a filter, a flag and a display column."""

    name: str
    flag: str
    title: str
    kind: str = "string"


EXT_COLUMNS = (
    ColumnDef("parent_symbol", "p", "PAR"),
    ColumnDef("scope", "s", "SCOPE"),
    ColumnDef("namespace", "ns", "NS"),
    ColumnDef("modifier", "m", "MOD"),
    ColumnDef("clue", "c", "CLUE"),
    ColumnDef("type", "t", "TYPE"),
    ColumnDef("is_definition", "d", "D", "int"),
)
TEXT_COLUMNS = tuple(c.name for c in EXT_COLUMNS if c.kind == "string")
CORE = (("symbol", "string"), ("directory", "string"), ("filename", "string"), ("line", "int"), ("context", "string"), ("full_symbol", "string"), ("source_location", "string"))
COLUMNS = (*CORE, *((c.name, c.kind) for c in EXT_COLUMNS))
#: seq is the order of insertion in its file, which tells the rows of a file apart, and the last key of every order; the span is parsed once, at ingest.
STORED = (*COLUMNS, ("seq", "long"), ("span_start", "int"), ("span_end", "int"))
SCHEMA = T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}[k]) for n, k in STORED])
ORDER = ("directory", "filename", "line", "seq")

#: compact name -> full name
CONTEXTS = {
    "CLASS": "CLASS", "IFACE": "INTERFACE", "FUNC": "FUNCTION", "ARG": "ARGUMENT", "VAR": "VARIABLE", "EXC": "EXCEPTION", "TYPE": "TYPE", "PROP": "PROPERTY",
    "COM": "COMMENT", "STR": "STRING", "FILE": "FILENAME", "IMP": "IMPORT", "EXP": "EXPORT", "CALL": "CALL", "NS": "NAMESPACE", "ENUM": "ENUM", "CASE": "CASE",
    "TRAIT": "TRAIT", "LAM": "LAMBDA", "LABEL": "LABEL", "GOTO": "GOTO", "MACRO": "MACRO",
}
NOISE = ("COM", "STR")
TOC_CONTEXTS = ("FILE", "CLASS", "FUNC", "ENUM", "TYPE", "MACRO", "IMP")


def context_of(name: str) -> str:
    """The compact context that a compact or full name, in any case, stands for."""
    up = name.upper()
    for compact, full in CONTEXTS.items():
        if up in (compact, full):
            return compact
    raise ValueError(f"unknown context: {name}")


def column_of(name: str) -> str:
    """A column by its name, flag or alias."""
    low = name.lower()
    alias = {"sym": "symbol", "symbol": "symbol", "ctx": "context", "par": "parent_symbol", "parent": "parent_symbol", "mod": "modifier", "def": "is_definition", "definition": "is_definition", "dir": "directory", "file": "filename"}
    alias |= {c.flag: c.name for c in EXT_COLUMNS} | {n: n for n, _ in COLUMNS}
    if low not in alias:
        raise ValueError(f"unknown column: {name}")
    return alias[low]
