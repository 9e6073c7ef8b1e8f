"""The store: tables of all projects in Parquet, replaced whole or in part, and read as snapshots.

Data lies in a folder a write, under the table's and project's. What is current is said by the last manifest, a
small table of (table, root_path, adapter_id, path); a write shows when its manifest is there, for all tables
at once, and a reader keeps the snapshot that it began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TABLES

MANIFEST = "table string, root_path string, adapter_id string, path string"
#: Tables whose rows belong to a file, and the column that names it.
BY_FILE = {"files": "relative_path", "chunks": "file_path", "occurrences": "file_path"}
#: Columns that searches look rows up by: their Parquet files say which values a row group hasn't.
LOOKED_UP = {
    "symbols": ("scip_symbol", "display_name"), "chunks": ("chunk_key", "primary_symbol", "file_path"), "chunk_symbols": ("chunk_key",),
    "edges": ("src_symbol", "dst_symbol"), "occurrences": ("symbol",), "embeddings": ("owner_key",),
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        top = path(f"{self.path}/manifests")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit())

    def _latest(self) -> tuple[int, str | None]:
        """The last version and its manifest's folder. A version whose claim is still empty isn't there yet."""
        fs, path = self._fs()
        for n in reversed(self._versions()):
            claim = path(f"{self.path}/manifests/{n}")
            size = fs.getFileStatus(claim).getLen()
            if size:
                stream = fs.open(claim)
                try:
                    return n, str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return 0, None

    def _read(self, folder: str | None) -> list[tuple]:
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).json(folder).collect()] if folder else []

    def manifest(self) -> list[tuple]:
        """(table, root_path, adapter_id, path) of the current snapshot."""
        return self._read(self._latest()[1])

    def _publish(self, change, own: tuple[str, str] | None = None, base: list[tuple] | None = None) -> None:
        """change: rows of a manifest -> those of the next. The manifest is written aside; then a small file of
        the next number, which only one writer can create, names it. Who comes second changes the other's
        manifest, unless it has other rows of `own`, the project that base was read for."""
        fs, path = self._fs()
        while True:
            number, folder = self._latest()
            rows = self._read(folder)
            if own and sorted(r for r in rows if r[1:3] == own) != sorted(r for r in base or [] if r[1:3] == own):
                raise RuntimeError(f"another writer has changed {own} meanwhile")
            aside = f"{self.path}/manifests/rows-{uuid.uuid4().hex}"
            self.spark.createDataFrame(change(rows), MANIFEST).coalesce(1).write.json(aside)
            taken = self._versions()
            number = max([number, *(n for n in taken if n > number)]) + 1
            try:
                out = fs.create(path(f"{self.path}/manifests/{number}"), False)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    continue
                raise
            out.write(aside.encode())
            out.close()
            return

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions, and folders that no version left names. How many folders went.
        To be run while nothing is written, since a write's folders are in no manifest yet."""
        fs, path = self._fs()
        versions, named = self._versions(), set()
        for n in versions[-max(1, keep) :]:
            stream = fs.open(path(f"{self.path}/manifests/{n}"))
            folder = str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            if folder:
                named |= {folder} | {r[3] for r in self._read(folder)}
        for n in versions[: -max(1, keep)]:
            fs.delete(path(f"{self.path}/manifests/{n}"), False)
        names = {x.rstrip("/").rpartition("/")[2] for x in named}
        gone = 0
        for top in [path(f"{self.path}/manifests"), *(path(f"{self.path}/data/{t}") for t in TABLES)]:
            for s in fs.listStatus(top) if fs.exists(top) else []:
                if s.isDirectory() and s.getPath().getName() not in names:
                    gone += fs.delete(s.getPath(), True)
        return gone

    # -- reading

    def table(self, name: str, where: list[tuple] | None = None) -> DataFrame:
        """A table's current rows, with its declared columns; of an empty store, no rows."""
        paths = [r[3] for r in (self.manifest() if where is None else where) if r[0] == name]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def commit_of(self, root: str, adapter: str | None = None) -> str | None:
        """The commit that a root was indexed at; of several adapters the first by name."""
        rows = self.table("projects").where(F.col("root_path") == root)
        rows = rows if adapter is None else rows.where(F.col("adapter_id") == adapter)
        found = rows.orderBy("adapter_id").select("git_commit_hash").limit(1).collect()
        return found[0][0] if found else None

    # -- writing

    def _write(self, name: str, root: str, adapter: str, rows: DataFrame) -> tuple:
        folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        rows = rows.withColumns({"root_path": F.lit(root), "adapter_id": F.lit(adapter)})
        declared = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP.get(name, ())}
        rows.select(*declared).write.options(**filters).parquet(folder)
        return name, root, adapter, folder

    @staticmethod
    def _other(rows: list[tuple], root: str, adapter: str, tables: Iterable[str]) -> list[tuple]:
        tables = set(tables)
        return [r for r in rows if not (r[1] == root and r[2] == adapter and r[0] in tables)]

    def stage(self, name: str, root: str, adapter: str, rows: DataFrame) -> tuple[tuple, DataFrame]:
        """Writes rows that no reader sees yet, for replace(), and reads them back for what is derived from them."""
        entry = self._write(name, root, adapter, rows)
        return entry, self.spark.read.schema(TABLES[name]).parquet(entry[3])

    def replace(self, root: str, adapter: str, payload: dict[str, DataFrame | tuple]) -> None:
        """All tables of (root, adapter) anew, from rows or stage(); other projects' rows stay as they are. A table
        that payload hasn't is empty afterwards, but for projects, of which the old row stays."""
        new = [rows if isinstance(rows, tuple) else self._write(name, root, adapter, rows) for name, rows in payload.items()]
        gone = set(TABLES) - {"index_runs"} - ({"projects"} - set(payload))
        self._publish(lambda rows: self._other(rows, root, adapter, gone) + new)

    def update(self, root: str, adapter: str, changed: DataFrame, payload: dict[str, DataFrame]) -> None:
        """changed: relative_path of files that changed or went. Rows of other files are kept where a table is
        by file, payload holds the changed files' rows; other tables in payload replace the old. Vectors are
        kept as far as payload hasn't new ones and their chunks are still there."""
        base = self.manifest()
        new, now = [], {}
        names = sorted(payload, key=lambda n: n == "embeddings")
        if "chunks" in payload and "embeddings" not in payload and any(r[:3] == ("embeddings", root, adapter) for r in base):
            names.append("embeddings")
        for name in names:
            rows = payload.get(name)
            if name in BY_FILE:
                rows = merged(self._own(name, root, adapter, base), rows, F.col(BY_FILE[name]), changed)
            elif name == "embeddings":
                old = self._own(name, root, adapter, base)
                if "chunks" in now:
                    keys = now["chunks"].select(F.lit("chunk").alias("owner_type"), F.col("chunk_key").alias("owner_key"))
                    old = old.where("owner_type <> 'chunk'").unionByName(old.join(keys, ["owner_type", "owner_key"], "left_semi"), allowMissingColumns=True)
                if rows is not None:
                    old = old.join(rows.select("owner_type", "owner_key"), ["owner_type", "owner_key"], "left_anti").unionByName(rows, allowMissingColumns=True)
                rows = old
            new.append(self._write(name, root, adapter, rows))
            now[name] = self.spark.read.schema(TABLES[name]).parquet(new[-1][3])
        self._publish(lambda rows: self._other(rows, root, adapter, names) + new, (root, adapter), base)

    def _own(self, name: str, root: str, adapter: str, where: list[tuple] | None = None) -> DataFrame:
        return self.table(name, [r for r in (self.manifest() if where is None else where) if r[1] == root and r[2] == adapter])

    def drop_stale(self, root: str, keep: Iterable[str]) -> int:
        """Drops projects at or under a root whose adapter isn't kept; without any to keep, all. How many went."""
        keep = set(keep)
        of = lambda rows: {(r[1], r[2]) for r in rows if (r[1] == root or r[1].startswith(root.rstrip("/") + "/")) and r[2] not in keep and r[0] != "index_runs"}
        stale = of(self.manifest())
        if stale:
            self._publish(lambda rows: [r for r in rows if (r[1], r[2]) not in stale])
        return len(stale)

    def log_run(self, root: str, adapter: str, run: DataFrame, most: int = 16) -> None:
        """Appends rows to the run log, which no replacement touches. After `most` runs a project's log is
        written anew as one folder, so that a manifest doesn't grow with the runs."""
        old = [r for r in self.manifest() if r[:3] == ("index_runs", root, adapter)]
        if len(old) < most:
            row = self._write("index_runs", root, adapter, run)
            self._publish(lambda rows: rows + [row])
            return
        row = self._write("index_runs", root, adapter, self.table("index_runs", old).unionByName(run, allowMissingColumns=True).coalesce(1))
        self._publish(lambda rows: [r for r in rows if r not in old] + [row])

    def status(self) -> DataFrame:
        snapshot = self.manifest()
        return status_counts(*(self.table(n, snapshot) for n in ("projects", "files", "symbols", "chunks", "occurrences")))


def merged(old: DataFrame, new: DataFrame, file: Column, changed: DataFrame) -> DataFrame:
    """Old rows of files that didn't change, and the new rows."""
    gone = changed.select(F.col("relative_path").alias("_changed"))
    return old.join(gone, file == F.col("_changed"), "left_anti").unionByName(new, allowMissingColumns=True)


def merged_vectors(old: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old: owner_key, text_hash, vector; texts: owner_key, text_hash now. What can be kept, and what must be embedded:
    the key alone doesn't do, since a chunk may have the same place and another text."""
    kept = old.join(texts.select("owner_key", "text_hash"), ["owner_key", "text_hash"], "left_semi")
    return kept, texts.join(kept.select("owner_key"), "owner_key", "left_anti")


def status_counts(projects: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """A row a project with the numbers of its rows, by root and adapter. Every table is counted once, by partial sums."""
    out = projects
    key = ["root_path", "adapter_id"]
    for name, rows in (("files", files), ("symbols", symbols), ("chunks", chunks), ("occurrences", occurrences)):
        out = out.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}")), key, "left")
    counts = [F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("files", "symbols", "chunks", "occurrences")]
    return out.select(*projects.columns, *counts).orderBy(*key)


def under(root_path: Column, root: str) -> Column:
    """At a root, or below it."""
    return (root_path == root) | root_path.startswith(root.rstrip("/") + "/")


def stale(projects: DataFrame, root: str, keep: list[str]) -> DataFrame:
    rows = projects.where(under(F.col("root_path"), root))
    return rows.where(~F.col("adapter_id").isin(keep)) if keep else rows


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def ends(rows: DataFrame, by: list[str], order: str, key: str, most: int) -> DataFrame:
    """The first and last `most` rows of each `by` by order and key, with `a`, the number from the first: what a
    summary shows. Each end is a limited window, of which tasks drop the rest before the shuffle."""
    w = Window.partitionBy(*by)
    first = rows.withColumn("a", F.row_number().over(w.orderBy(order, key)))
    last = rows.withColumn("z", F.row_number().over(w.orderBy(F.desc(order), F.desc(key)))).where(F.col("z") <= most)
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    last = last.join(n, by).withColumn("a", (F.col("n") - F.col("z") + 1).cast("int")).where(F.col("a") > most).drop("z", "n")
    return first.where(F.col("a") <= most).unionByName(last)
