"""Keeping the table fresh: a stream of file changes, applied in batches.

The source compares snapshots of a tree (path, time, size), so it sees
modifications and deletions, which a plain file stream doesn't.  A trigger is
the silence that closes a burst.  In a batch the last event of a path wins, or
with ``first_wins`` the first.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from symsift.sources.extract import extract
from symsift.sources.files import IndexStore, Walk, read_tree

EVENT = "path string, event_type string, event_time double"


def snapshot(root: str, walk: Walk) -> dict[str, list[float]]:
    out = {}
    skip = set(walk.ignore) | set(walk.exclude_dirs)
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip]
        for n in names:
            path = os.path.join(folder, n)
            rel = os.path.relpath(path, root)
            if walk.accepts(rel):
                try:
                    s = os.stat(path)
                except FileNotFoundError:
                    continue
                out[rel] = [s.st_mtime, s.st_size]
    return out


def difference(old: dict, new: dict, now: float) -> list[tuple[str, str, float]]:
    events = [(p, "MODIFIED" if p in old else "CREATED", now) for p, v in new.items() if old.get(p) != v]
    return sorted(events + [(p, "DELETED", now) for p in old if p not in new])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.walk = Walk(exclude_dirs=tuple(filter(None, options.get("exclude_dirs", "").split(","))), exclude_files=tuple(filter(None, options.get("exclude_files", "").split(","))))
        self.log: dict[int, list] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0, "files": "{}"}

    def read(self, start: dict):
        old = json.loads(start["files"])
        new = snapshot(self.root, self.walk)
        events = difference(old, new, time.time())
        if not events:
            return iter(()), start
        n = start["n"] + 1
        self.log[n] = events
        return iter(events), {"n": n, "files": json.dumps(new)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self.log.get(end["n"]) or difference(json.loads(start["files"]), json.loads(end["files"]), time.time()))


class TreeChanges(DataSource):
    """``spark.readStream.format("tree_changes").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Reader(dict(self.options))


def one_per_path(events: DataFrame, first_wins: bool = False) -> DataFrame:
    order = F.col("event_time").asc() if first_wins else F.col("event_time").desc()
    w = Window.partitionBy("path").orderBy(order, "event_type")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_changes(store: IndexStore, root: str, events: DataFrame, first_wins: bool = False) -> None:
    """One batch, one version: deleted files lose their rows, changed ones are parsed again and replaced.

    Contents come by a join on the path with a read of the tree; no list of paths
    is collected.  A changed file that is gone by now keeps its rows until the
    event of its deletion.
    """
    events = one_per_path(events, first_wins).cache()
    at = events.select("path", "event_type", F.concat(F.lit("./"), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)).alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"))
    changed = at.where("event_type <> 'DELETED'").select("directory", "filename")
    gone = at.where("event_type = 'DELETED'").select("directory", "filename")
    if changed.limit(1).count():
        rows, failed = extract(read_tree(store.spark, root).join(changed, ["directory", "filename"], "left_semi"))
        store.apply(rows, gone, failed)
    else:
        store.apply(None, gone)
    events.unpersist()


def watch(spark: SparkSession, root: str, store: IndexStore, checkpoint: str, once: bool = False, first_wins: bool = False, silence: str = "200 milliseconds", exclude_dirs: str = "", exclude_files: str = "") -> StreamingQuery:
    """Follow a tree; ``once`` takes what has changed and stops."""
    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("tree_changes").option("path", root).option("exclude_dirs", exclude_dirs).option("exclude_files", exclude_files).load()
    out = events.writeStream.foreachBatch(lambda df, _: apply_changes(store, root, df, first_wins)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=silence)).start()
