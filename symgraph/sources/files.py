"""File listings: extension, directory, ignore and low-value filters, manifests and the units they name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx

#: Folder of this engine's own state in a source tree.
STATE = ".symgraph"
#: Directories that hold no units; manifests by adapter; extensions and skipped directories by language.
SKIPPED = (
    ".git", ".hg", ".svn", STATE, "node_modules", "vendor", ".venv", "venv", "__pycache__", "target", "build", "dist", "out",
    ".idea", ".vscode", "testdata",
)
MANIFESTS = {
    "python-scip": ("pyproject.toml", "setup.py", "setup.cfg"),
    "typescript-scip": ("tsconfig.json",),
    "go-scip": ("go.mod",),
    "java-scip": ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"),
    "rust-scip": ("Cargo.toml",),
}
EXTENSIONS = {
    "python": (".py",), "typescript": (".ts", ".tsx", ".mts", ".cts"), "go": (".go",), "java": (".java", ".kt", ".kts", ".scala"), "rust": (".rs",),
}
SKIPPED_BY_LANGUAGE = {
    "python": (".git", STATE, ".venv", "venv", "__pycache__"),
    "typescript": (".git", STATE, "node_modules", "dist", "build", ".next", ".turbo"),
    "go": (".git", STATE, "vendor", "bin", "testdata"),
    "java": (".git", STATE, ".gradle", "build", "target", "out"),
    "rust": (".git", STATE, "target"),
}
#: Ends and a beginning of file names that count as tests or generated code.
LOW_VALUE_ENDS = ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "_test.py", ".pb.go", "_pb2.py", ".generated.go")
LOW_VALUE_START, LOW_VALUE_DIRECTORY = "test_", "testdata"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, path and bytes of all files under a root, hidden and empty ones too, by the file system itself:
    Spark's own listing leaves those out. A row a file is all that the driver holds."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.getFileStatus(top).getPath().toString().rstrip("/")
    found, files = fs.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        path = f.getPath().toString()
        files.append((path[len(base) + 1 :], path, f.getLen()))
    return spark.createDataFrame(files, "relative_path string, path string, bytes long")


def _contents(batches: Iterator) -> Iterator:
    """Bytes of files, a row at a time."""
    import pyarrow as pa
    from pyarrow.fs import FileSystem

    for b in batches:
        for name, path, size in zip(*(b.column(c).to_pylist() for c in ("relative_path", "path", "bytes")), strict=True):
            fs, at = FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/"))
            with fs.open_input_stream(at) as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["relative_path", "bytes", "content"])


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """listing() of a root with content, read in executors: by Spark, and those that its listing passes over,
    below names that begin with _ or ., one by one."""
    hidden = F.exists(F.split("relative_path", "/"), lambda p: p.startswith("_") | p.startswith("."))
    columns = ("relative_path", "bytes", "content")
    data = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("p"), "content")
    seen = files.where(~hidden & (F.col("bytes") > 0)).join(data, F.col("path") == F.col("p")).select(*columns)
    others = files.where(hidden & (F.col("bytes") > 0)).mapInArrow(_contents, "relative_path string, bytes long, content binary")
    empty = files.where("bytes = 0").select("relative_path", "bytes", F.lit(b"").alias("content"))
    return seen.unionByName(others).unionByName(empty)


def tree(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Files under a root: relative_path, content, bytes, content_hash, line_count."""
    out = with_contents(listing(spark, root), root)
    text = F.decode("content", "UTF-8")
    out = out.select("relative_path", "bytes", "content", F.sha2("content", 256).alias("content_hash"), fx.line_count(text).alias("line_count"))
    return out if with_content else out.drop("content")


def has_extension(path: Column, extensions: list[str]) -> Column:
    return fx.extension(path).isin([e.lower() for e in extensions]) if extensions else F.lit(True)


def in_directory(path: Column, names) -> Column:
    return F.arrays_overlap(fx.directories(path), F.lit(list(names)))


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    is_dir: bool


def ignore_rules(text: str) -> list[IgnoreRule]:
    """Rules of an ignore file: a line each, without blank ones and comments; a slash at the end is for directories."""
    lines = [x.strip() for x in text.splitlines()]
    rules = [IgnoreRule(x.removesuffix("/"), x.endswith("/")) for x in lines if x and not x.startswith("#")]
    return [r for r in rules if r.pattern]


def glob_regex(pattern: str) -> str:
    """A file name glob as a Java regex: * and ? don't cross slashes, classes may be negated by ^ or !."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether any rule applies: patterns with a slash are paths or their beginnings, globs match the base
    name, and other names, those of directories too, any part of the path."""
    tests = []
    for rule in rules:
        p = rule.pattern
        if "/" in p:
            tests.append((path == p) | path.startswith(p + "/"))
        elif not rule.is_dir and re.search(r"[*?\[]", p):
            tests.append(fx.base_name(path).rlike(glob_regex(p)))
        else:
            tests.append(F.array_contains(F.split(path, "/"), p))
    return fx.any_of(tests) if tests else F.lit(False)


def low_value(path: Column) -> Column:
    """Tests, generated code and test data."""
    name = fx.base_name(path)
    return fx.any_of([name.endswith(e) for e in LOW_VALUE_ENDS]) | name.startswith(LOW_VALUE_START) | F.array_contains(F.split(path, "/"), LOW_VALUE_DIRECTORY)


def source_files(listing: DataFrame, language: str, rules: list[IgnoreRule] = ()) -> DataFrame:
    path = F.col("relative_path")
    return listing.where(has_extension(path, list(EXTENSIONS[language])) & ~in_directory(path, SKIPPED_BY_LANGUAGE[language]) & ~ignored(path, list(rules)))


def units(listing: DataFrame) -> DataFrame:
    """Units of a tree: directory and adapter of each manifest outside skipped directories, each once."""
    pairs = [(name, adapter, k) for adapter, names in MANIFESTS.items() for k, name in enumerate(names)]
    dim = listing.sparkSession.createDataFrame(pairs, "manifest string, adapter_id string, nr int")
    path = F.col("relative_path")
    found = listing.where(~in_directory(path, SKIPPED)).withColumn("manifest", fx.base_name(path)).join(F.broadcast(dim), "manifest")
    found = found.withColumn("dir", F.array_join(fx.directories(path), "/"))
    return found.groupBy("dir", "adapter_id").agg(F.min_by("manifest", "nr").alias("manifest"))


def nearest_unit(paths: DataFrame, found: DataFrame) -> DataFrame:
    """For each path (column path, a directory) and adapter the deepest unit at or above it.

    Joined on the path's own prefixes, so it is an equi-join."""
    parts = F.split("path", "/")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))
    rows = paths.withColumn("a", F.explode(above)).select("path", "a.dir", "a.depth").distinct()
    return rows.join(found, "dir").groupBy("path", "adapter_id").agg(F.max_by("dir", "depth").alias("dir"))


def voted_root(found: DataFrame) -> DataFrame:
    """The root that most units have; of equal ones the longest, then the first."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(F.char_length("root")), "root").limit(1)
