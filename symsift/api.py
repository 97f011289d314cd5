"""The public interface: index, search, toc, watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symsift.operators import recipes, stats
from symsift.operators import search as S
from symsift.operators import toc as C
from symsift.operators.search import proximity, spans_of
from symsift.operators.toc import expand
from symsift.plans.spec import QuerySpec, parse_command
from symsift.sources.extract import extract
from symsift.sources.files import IndexStore, Walk, read_tree
from symsift.streaming.watch import watch

__all__ = ["IndexStore", "QuerySpec", "Walk", "expand", "index", "proximity", "recipes", "search", "spans_of", "stats", "toc", "watch"]


def index(spark: SparkSession, root: str, store: IndexStore, walk: Walk | None = None) -> DataFrame:
    """Parse a tree into a store; returns the files that failed."""
    rows, failed = extract(read_tree(spark, root, walk))
    store.upsert(rows, failed)
    return failed


def search(ci: DataFrame, what: QuerySpec | str, recover: bool = True) -> DataFrame:
    """Rows in order.  If there is none, a qualified name or a part of a symbol is tried."""
    spec = parse_command(what) if isinstance(what, str) else what
    if spec.within and (missing := S.missing_definitions(ci, spec.within)):
        raise ValueError(f"no definition found: {', '.join(missing)}")
    if spec.files_only:
        return S.files(ci, spec)
    out = S.search(ci, spec)
    if recover and (spec.qualified or len(spec.patterns) == 1) and not out.limit(1).count():
        other, why = S.recover(ci, spec)
        return S.search(ci, other) if why else out
    return out


def toc(ci: DataFrame, what: QuerySpec | str = "% --toc") -> DataFrame:
    return C.toc(ci, parse_command(what) if isinstance(what, str) else what)
