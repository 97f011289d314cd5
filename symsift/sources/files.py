"""Source trees: which files are taken, how they are read, and how the table is kept up to date."""

from __future__ import annotations

import fnmatch
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsift.schema import SCHEMA

EXTENSIONS = {
    "c": (".c", ".h", ".def"), "go": (".go",), "perl": (".pl", ".pm", ".t"), "php": (".php", ".phtml"), "python": (".py", ".pyw", ".pyi"), "rust": (".rs",),
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs"),
}
#: endings of prose and data, in lower case
PLAINTEXT = frozenset(
    ".adoc .asciidoc .authors .cfg .changelog .conf .config .contributors .copying .csv .doc .docx .editorconfig .env .gitattributes .gitignore .ini .install"
    " .json .license .log .markdown .md .odt .org .pdf .properties .readme .rst .rtf .toml .tsv .txt .xml .yaml .yml".split()
)


def known_extensions() -> tuple[str, ...]:
    """Endings of all languages."""
    return tuple(dict.fromkeys(e for ends in EXTENSIONS.values() for e in ends))


def is_plaintext(extension: str) -> bool:
    return extension.lower() in PLAINTEXT


def pattern_extension(pattern: str) -> str | None:
    """What a file pattern has from its last dot on, up to a wildcard; none without a letter there."""
    _, dot, tail = pattern.rpartition(".")
    tail = re.split("[%_*]", tail)[0]
    return dot + tail if dot and tail else None


def extension_warning(patterns: tuple[str, ...]) -> str | None:
    """What to tell about the first file filter whose ending no language has."""
    for p in patterns:
        end = pattern_extension(p)
        if end and end not in known_extensions():
            lines = [f"Files that end in {end} are not indexed."]
            if is_plaintext(end):
                lines.append("Only source code is, not prose or data.")
            lines.append("Indexed endings: " + " ".join(known_extensions()))
            return "\n".join(lines)
    return None


def resolve_data_file(name: str, data_dir: str | None = None) -> str | None:
    """The first of the folders that has a file: the one given or named by SYMSIFT_DATA_DIR, the working one, the user's, the package's."""
    import os
    from pathlib import Path

    home = Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share") / "symsift"
    places = [data_dir or os.environ.get("SYMSIFT_DATA_DIR"), ".", home, Path(__file__).parent / "data"]
    return next((str(Path(p) / name) for p in places if p and (Path(p) / name).is_file()), None)


def language_of(path: str) -> str | None:
    for lang, ends in EXTENSIONS.items():
        if path.endswith(ends):
            return lang
    return None


def language_column(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for lang, ends in EXTENSIONS.items():
        out = F.when(path.rlike("(" + "|".join(map(re.escape, ends)) + ")$"), lang).otherwise(out)
    return out


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[]", pattern))


def glob_regex(pattern: str) -> str:
    """A glob whose wildcards stop at a slash."""
    out = fnmatch.translate(pattern)
    return re.sub(r"\(\?>\.\*\?", "(?>[^/]*?", out).replace(".*", "[^/]*").removesuffix(r"\z").removesuffix(r"\Z").removeprefix("(?s:").removesuffix(")")


@dataclass(frozen=True)
class Walk:
    """Which files of a tree count."""

    extensions: tuple[str, ...] = tuple(e for ends in EXTENSIONS.values() for e in ends)
    ignore: tuple[str, ...] = ("node_modules", ".git", "__pycache__")
    exclude_dirs: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    shebang: bool = True

    def rejected(self) -> str:
        """One regular expression over paths that are left out."""
        parts = []
        for p in self.ignore:
            body = glob_regex(p.strip("/")) if is_glob(p) else re.escape(p.strip("/"))
            parts.append(f"(^|/){body}(/|$)")
        parts += [f"(^|/){re.escape(d.strip('/'))}/" for d in self.exclude_dirs]
        parts += [f"(^|/){glob_regex(f) if is_glob(f) else re.escape(f)}$" for f in self.exclude_files]
        return "|".join(parts) or r"[^\s\S]"

    def accepts(self, path: str) -> bool:
        return path.endswith(self.extensions) and not re.search(self.rejected(), path)

    def filter(self, path: Column, first_line: Column | None = None) -> Column:
        ok = path.rlike("(" + "|".join(map(re.escape, self.extensions)) + ")$")
        if self.shebang and first_line is not None and ".pl" in self.extensions:
            ok = ok | (~path.rlike(r"\.[^/]+$") & first_line.rlike("^#!.*perl"))
        return ok & ~path.rlike(self.rejected())


def relative(path: Column, root: str) -> tuple[Column, Column]:
    """(directory, filename): the directory starts with ./ unless it leaves the root, and ends with a slash."""
    bare = F.regexp_replace(path, "^(file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/*", "")
    bare = F.regexp_replace(bare, r"^(\./)+", "")
    directory = F.regexp_extract(bare, r"^(.*/)?[^/]*$", 1)
    return F.when(directory.rlike(r"^(/|\.\./)"), directory).otherwise(F.concat(F.lit("./"), directory)), F.regexp_extract(bare, r"([^/]*)$", 1)


def read_tree(spark: SparkSession, root: str, walk: Walk | None = None) -> DataFrame:
    """directory, filename, lang, content, modified of the files under a root."""
    walk = walk or Walk()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not walk.shebang:  # else files without an ending must be opened
        reader = reader.option("pathGlobFilter", "*{" + ",".join(walk.extensions) + "}")
    files = reader.load(root).where(~F.col("path").rlike(walk.rejected()) & (walk.filter(F.col("path")) | F.lit(walk.shebang) & ~F.col("path").rlike(r"\.[^/]+$")))
    files = files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))
    directory, name = relative(F.col("path"), root)
    return files.where(walk.filter(F.col("path"), F.substring_index("content", "\n", 1))).select(directory.alias("directory"), name.alias("filename"), F.coalesce(language_column(F.col("path")), F.lit("perl")).alias("lang"), "content", "modified")


def read_lines(spark: SparkSession, path: str, most_lines: int, most_chars: int) -> list[str]:
    """The lines of a small configuration file without blanks and # comments, checked against its limits."""
    rows = [r[0].strip() for r in spark.read.text(path).limit(most_lines + 1).collect()]
    if len(rows) > most_lines:
        raise ValueError(f"{path}: more than {most_lines} lines")
    lines = [w for w in rows if w and not w.startswith("#")]
    if not lines:
        raise ValueError(f"{path}: empty")
    if long := next((w for w in lines if len(w) > most_chars), None):
        raise ValueError(f"{path}: a line over {most_chars} characters: {long[:40]}")
    return lines


def read_word_list(spark: SparkSession, path: str, most_lines: int = 1024, most_chars: int = 63) -> list[str]:
    return read_lines(spark, path, most_lines, most_chars)


def read_regex_list(spark: SparkSession, path: str, most_lines: int = 128, most_chars: int = 255) -> list[str]:
    """Patterns; one that can't be compiled is an error."""
    out = read_lines(spark, path, most_lines, most_chars)
    for p in out:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"{path}: {p}: {e}") from e
    return out


def read_extension_list(spark: SparkSession, path: str, most_lines: int = 16, most_chars: int = 15) -> list[str]:
    """Endings, with their dot."""
    return ["." + e.removeprefix(".") for e in read_lines(spark, path, most_lines, most_chars)]


def preflight(spark: SparkSession, words: tuple[str, ...] = (), patterns: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with configuration files, all of them, before work begins."""
    wrong = []
    for read, paths in ((read_word_list, words), (read_regex_list, patterns), (read_extension_list, extensions)):
        for path in paths:
            try:
                read(spark, path)
            except Exception as e:  # noqa: BLE001  every fault is reported
                wrong.append(str(e).splitlines()[0])
    return wrong


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a manifest without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' AND NOT startswith(name, '#')")


MESSAGES = "info struct<exit_status:string,model_stats:struct<instance_cost:double,api_calls:long>>, instance_id string, messages array<struct<role:string,content:string,tokens:long>>"


def read_trajectories(spark: SparkSession, paths: str, schema: str = MESSAGES) -> DataFrame:
    """One row per message of JSON files, with its file, place (from 1), cost and exit status; files that can't be read give none."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths).withColumn("file", F.input_file_name())
    flat = rows.select("file", "instance_id", F.col("info.exit_status").alias("exit_status"), F.col("info.model_stats.instance_cost").alias("cost"), F.posexplode("messages").alias("_p", "_m"))
    return flat.select("file", "instance_id", "exit_status", "cost", (F.col("_p") + 1).alias("turn"), "_m.*")


def read_runs(spark: SparkSession, paths: str, schema: T.StructType) -> DataFrame:
    """CSV files of several batches with their batch, taken from the folder's name."""
    df = spark.read.csv(paths, header=True, schema=schema)
    return df.withColumn("batch", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))


LEDGER = "batch_id string, arm string, rep string, instance_id string, model string, started_at timestamp, finished_at timestamp, exit_status string, ok boolean"


def read_ledger(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    """JSON lines; bad lines and rows without both times are left out."""
    rows = spark.read.schema(LEDGER).json(path, mode="DROPMALFORMED").where("started_at IS NOT NULL AND finished_at IS NOT NULL")
    rows = rows.withColumn("duration_sec", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6)
    return rows.where(F.col("batch_id") == batch) if batch else rows


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


@dataclass
class IndexStore:
    """The occurrence table on disk, partitioned by language, versioned by folder.

    A write goes to a staging folder that is then renamed to the next version,
    so a reader sees one version or the other and a failed write leaves the old
    one in place.  The version before the last stays for readers still in it.
    """

    spark: SparkSession
    path: str
    schema: T.StructType = field(default_factory=lambda: T.StructType([*SCHEMA.fields, T.StructField("lang", T.StringType())]))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    def _folder(self, version: int) -> str:
        return f"{self.path}/version-{version:09d}"

    def read(self) -> DataFrame:
        have = self.versions()
        return self.spark.read.schema(self.schema).parquet(self._folder(have[-1])) if have else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        """The next version; if another writer was first, the work is thrown away and an error raised."""
        have = self.versions()
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        ordered = rows.select(*self.schema.names).repartition("lang", "directory").sortWithinPartitions("directory", "filename", "line", "seq")
        ordered.write.partitionBy("lang").parquet(staged)
        fs, source = self._fs(staged)
        target = self._fs(self._folder(have[-1] + 1 if have else 1))[1]
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise RuntimeError(f"{target} is there: another writer was first")
        for old in have[:-1]:
            fs.delete(self._fs(self._folder(old))[1], True)

    def delete_files(self, files: DataFrame) -> None:
        """Rows of (directory, filename) go."""
        self.apply(None, files)

    def upsert(self, rows: DataFrame, failed: DataFrame | None = None) -> None:
        """All rows of the files in ``rows`` are replaced; files that failed to parse keep their old ones."""
        self.apply(rows, None, failed)

    def apply(self, rows: DataFrame | None, gone: DataFrame | None, failed: DataFrame | None = None) -> None:
        """Changed and deleted files in one new version: a reader sees all of a batch or nothing."""
        key = ["directory", "filename"]
        touched = []
        if rows is not None:
            if failed is not None:
                rows = rows.join(failed.select(*key), key, "left_anti")
            touched.append(rows.select(*key).distinct())
        if gone is not None:
            touched.append(gone.select(*key).distinct())
        if not touched:
            return
        kept = self.read().join(reduce(DataFrame.unionByName, touched), key, "left_anti")
        self.write(kept.unionByName(rows) if rows is not None else kept)
