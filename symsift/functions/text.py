"""Patterns and text functions as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: str) -> str:
    """Lower case for ASCII letters alone."""
    return text.translate(_FOLD)


def fold_col(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def pattern_tokens(pattern: str) -> list[tuple[str, bool]]:
    """(character, is wildcard): ``*`` and ``%`` any run, ``.`` and ``_`` one character, a backslash makes the next literal."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append((pattern[i + 1], False))
            i += 2
            continue
        out.append({"*": ("%", True), ".": ("_", True), "%": ("%", True), "_": ("_", True)}.get(c, (c, False)))
        i += 1
    return out


def like_pattern(pattern: str) -> str:
    """A LIKE pattern with ``!`` as its escape, folded."""
    return "".join(c if wild else fold("!" + c if c in "%_!" else c) for c, wild in pattern_tokens(pattern))


def has_wildcards(pattern: str) -> bool:
    return any(w for _, w in pattern_tokens(pattern))


def unescape(pattern: str) -> str:
    return re.sub(r"\\([%_\\])", r"\1", pattern)


def split_alternation(term: str) -> list[str]:
    """``a|b`` or ``a\\|b`` -> its parts, empty ones left out."""
    return [p for p in re.split(r"\\?\|", term) if p]


def split_qualified(term: str) -> tuple[str, str] | None:
    """``a.b.c`` -> ("a.b", "c") if both have two characters or more and no wildcard."""
    head, dot, tail = term.rpartition(".")
    return (head, tail) if dot and len(head) >= 2 and len(tail) >= 2 and not re.search(r"[%*]", term) else None


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(column: str, pattern: str, folded: bool = False) -> Column:
    """Case-insensitive (ASCII) match in the cheapest form: equality, prefix or LIKE."""
    col = F.col(column) if folded else fold_col(F.col(column))
    tokens = pattern_tokens(pattern)
    if not any(w for _, w in tokens):
        return col == fold("".join(c for c, _ in tokens))
    if tokens[-1] == ("%", True) and not any(w for _, w in tokens[:-1]):
        return col.startswith(fold("".join(c for c, _ in tokens[:-1])))
    name = f"`{column}`" if folded else f"translate(`{column}`, '{UPPER}', '{LOWER}')"
    return F.expr(f"{name} LIKE {literal(like_pattern(pattern))} ESCAPE '!'")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def matches_any(column: str, patterns: list[str], folded: bool = False) -> Column:
    """OR of patterns; exact ones become one IN list."""
    exact = [fold("".join(c for c, _ in pattern_tokens(p))) for p in patterns if not has_wildcards(p)]
    parts = [matches(column, p, folded) for p in patterns if has_wildcards(p)]
    if exact:
        parts.append((F.col(column) if folded else fold_col(F.col(column))).isin(*exact))
    return any_of(parts)


def contains_value(column: str, value: str) -> Column:
    """Fuzzy metadata filter: the value anywhere, its own wildcards honoured."""
    return F.expr(f"translate(`{column}`, '{UPPER}', '{LOWER}') LIKE {literal('%' + like_pattern(value) + '%')} ESCAPE '!'")


def file_pattern(text: str) -> tuple[str | None, str]:
    """(directory pattern, file pattern) of a file filter.

    ``.ext`` means any file with that ending; a name has no directory; ``a/b``
    looks for the directory anywhere; an absolute path is taken as it is; a
    trailing slash means any file.  The dot of a leading ``./`` is a wildcard.
    """
    if text.startswith(".") and "/" not in text and not text.startswith(".."):
        return None, "%\\" + text
    if "/" not in text:
        return None, text
    head, _, tail = text.rpartition("/")
    tail = tail or "%"
    if head.startswith("/"):
        return head + "/", tail
    return "%" + head + "/" if head.startswith(".") else "%/" + head + "/", tail


CLEAN = r"[^A-Za-z0-9_./:@#?&=+^$!~<>\[\]%-]"
PUNCTUATION = ("[", "]", "{", "}", "(", ")", "=", "+", "+=", "++", ";", ",")
STOPWORDS = ("the", "and", "of", "is", "in", "to", "or", "by", "for", "that", "die", "der", "und", "la", "de", "que", "el")
_UNITS = "em|rem|vh|vw|vmin|vmax|ch|ex|cm|mm|in|pt|pc"
NOISE_PATTERNS = (
    r"^[0-9]+(px|st|nd|rd|th)$", r"^#([0-9a-fA-F]{3}){1,2}$", r"^0x[0-9a-fA-F]+$", r"^[0-9][0-9a-fA-F]*[a-fA-F][0-9a-fA-F]*$", r"^[0-9]+[smhdywµun]s?$",
    r"^[0-9]+[kmg]?[hH][zZ]$", r"^[0-9]+[kmgtpKMGTP][bB]$", r"^[0-9]+x[0-9]+$", rf"^[0-9]+(\.[0-9]+)?({_UNITS}|%)$", r"^rgba?\([0-9,.\s]+\)$", r"^hsla?\([0-9,%.\s]+\)$",
)


def clean_word(word: Column) -> Column:
    """Only characters of symbols are kept; the rest is deleted."""
    return F.regexp_replace(word, CLEAN, "")


def admitted(word: Column, keywords: tuple[str, ...] = (), stopwords: tuple[str, ...] = STOPWORDS, patterns: tuple[str, ...] = NOISE_PATTERNS) -> Column:
    """The admission filter: long enough, no number, no keyword or stop word, no noise pattern."""
    low = fold_col(word)
    ok = (F.length(word) >= 2) & ~word.isin(*PUNCTUATION) & ~word.rlike("^[0-9]+$") & ~low.isin(*keywords, *stopwords)
    return ok & ~word.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else ok


def search_key(word: Column) -> Column:
    """The symbol a word of a comment or string is found by."""
    return F.regexp_replace(F.lower(word), "[.,!?:;]+$", "")


def strip_sigil(word: Column) -> Column:
    return F.when((F.length(word) > 1) & word.startswith("$"), F.substring(word, 2, 1 << 30)).otherwise(word)


def strip_comment(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*(//+|/\*+|#+)", ""), r"\*+/\s*$", "")


def base_name(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def span_of(location: Column, part: int) -> Column:
    """start line, start column, end line, end column (1 to 4) of ``r:c - r:c``, null if it is none."""
    got = F.regexp_extract(location, r"^(\d+):(\d+) - (\d+):(\d+)", part)
    return F.when(got != "", got).cast("int")


def format_span(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.format_string("%d:%d - %d:%d", a, b, c, d)


def highlighted(text: Column, pattern: str) -> Column:
    """Matches of a pattern without wildcards in green."""
    return text if re.search("[%_]", pattern) else F.regexp_replace(text, "(?i)(" + re.escape(pattern) + ")", "\u001b[42m$1\u001b[0m")
