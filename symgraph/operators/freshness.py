"""Change detection: indexed files against current ones, diffs against relevant paths, and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx
from ..sources import git
from .tables import Store

REINDEX_RATIO = 0.22
WARN_RATIO = REINDEX_RATIO * 2 / 3


def changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """indexed, current: relative_path, content_hash, line_count. A row a path of either: state (clean, dirty, new,
    missing) and changed_lines, all the lines a file that isn't clean has, or had if it went."""
    old = indexed.select("relative_path", F.col("content_hash").alias("old_hash"), F.col("line_count").alias("old_lines"))
    new = current.select("relative_path", F.col("content_hash").alias("new_hash"), F.col("line_count").alias("new_lines"))
    both = old.join(new, "relative_path", "full_outer")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "missing").when(F.col("old_hash") != F.col("new_hash"), "dirty").otherwise("clean")
    lines = F.when(F.col("state") == "clean", 0).otherwise(F.coalesce("new_lines", "old_lines"))
    return both.withColumn("state", state).withColumn("changed_lines", lines)


def freshness(changed: DataFrame) -> DataFrame:
    """One row over changes(): counts by state, ratios of files and lines, and status."""
    n = lambda name, test: F.sum(F.when(test, 1).otherwise(0)).alias(f"n_{name}")
    states = [n(s, F.col("state") == s) for s in ("new", "missing", "dirty", "clean")]
    sides = [n("indexed", F.col("old_hash").isNotNull()), n("current", F.col("new_hash").isNotNull())]
    out = changed.agg(*states, *sides, F.sum("changed_lines").alias("changed_lines"), F.coalesce(F.sum("new_lines"), F.lit(0)).alias("total_lines"))
    return _rated(out)


def _rated(out: DataFrame) -> DataFrame:
    files = F.col("n_new") + F.col("n_missing") + F.col("n_dirty")
    most = F.greatest("n_indexed", "n_current")
    out = out.withColumn("changed_ratio", F.when(most > 0, files / most).otherwise(0.0))
    out = out.withColumn("line_ratio", sx.changed_ratio(F.col("changed_lines"), F.col("total_lines")))
    return out.withColumn("status", F.when(F.col("line_ratio") > 0, "stale").otherwise("clean"))


def decision(ratio, is_dirty):
    """What a search does first: reindex, warn or nothing."""
    return F.when(is_dirty & (ratio >= REINDEX_RATIO), "reindex").when(is_dirty & (ratio >= WARN_RATIO), "warn").otherwise("none")


def diff_stats(diff: DataFrame, relevant: DataFrame) -> DataFrame:
    """diff: path (renames in a diff's form), added, deleted. relevant: relative_path. Sums by the first of a
    row's paths, old then new, that is relevant; rows without one drop out."""
    rows = diff.withColumn("row_id", F.xxhash64("path")).select("row_id", "path", "added", "deleted", F.posexplode(fx.renamed_paths(F.col("path"))).alias("pos", "relative_path"))
    found = rows.join(relevant.select("relative_path"), "relative_path", "left_semi")
    first = found.groupBy("row_id", "path", "added", "deleted").agg(F.min_by("relative_path", "pos").alias("relative_path"))
    return first.groupBy("relative_path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def touched(changed: DataFrame, untracked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Paths that changed or are new, each once, as far as they are relevant."""
    both = changed.select("relative_path").union(untracked.select("relative_path")).distinct()
    return both.join(relevant.select("relative_path"), "relative_path", "left_semi")


def must_reindex(indexed: DataFrame, detected: DataFrame) -> DataFrame:
    """Projects (root_path, adapter_id) that are on one side only, and why: not indexed, or vanished."""
    key = ["root_path", "adapter_id"]
    missing = detected.join(indexed, key, "left_anti").select(*key, F.lit("not indexed").alias("reason"))
    vanished = indexed.join(detected, key, "left_anti").select(*key, F.lit("vanished").alias("reason"))
    return missing.unionByName(vanished)


def git_freshness(indexed: DataFrame, current: DataFrame, diff: DataFrame, changed: DataFrame, untracked: DataFrame) -> DataFrame:
    """The row of freshness() by a diff since the indexed commit: files count by the side they are on, lines by the
    diff, and by their length for new files that git doesn't track."""
    old = indexed.select("relative_path", F.lit(True).alias("in_old"))
    new = current.select("relative_path", F.lit(True).alias("in_new"), "line_count")
    both = old.join(new, "relative_path", "full_outer")
    loose = untracked.select("relative_path", F.lit(True).alias("is_untracked")).distinct()
    paths = touched(changed, untracked, both).join(both, "relative_path").join(loose, "relative_path", "left")
    state = F.when(F.col("in_new").isNull(), "missing").when(F.col("in_old").isNull(), "new").otherwise("dirty")
    own = F.when((state == "new") & F.col("is_untracked"), F.col("line_count")).otherwise(0)
    n = lambda name: F.coalesce(F.sum((state == name).cast("int")), F.lit(0)).alias(f"n_{name}")
    files = paths.agg(n("new"), n("missing"), n("dirty"), F.coalesce(F.sum(own), F.lit(0)).alias("own_lines"))
    lines = diff_stats(diff.where("added > 0 OR deleted > 0"), paths).agg(F.coalesce(F.sum(F.col("added") + F.col("deleted")), F.lit(0)).alias("diff_lines"))
    sides = both.agg(F.count("in_old").alias("n_indexed"), F.count("in_new").alias("n_current"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    out = files.join(F.broadcast(lines)).join(F.broadcast(sides))  # a row each
    out = out.withColumn("changed_lines", F.col("own_lines") + F.col("diff_lines")).withColumn("n_clean", F.col("n_indexed") - F.col("n_missing") - F.col("n_dirty"))
    return _rated(out).select("n_new", "n_missing", "n_dirty", "n_clean", "n_indexed", "n_current", "changed_lines", "total_lines", "changed_ratio", "line_ratio", "status")


def of_unit(store: Store, root: str, adapter: str, current: DataFrame) -> DataFrame:
    """How fresh a unit's index is: by git if its folder is a repository that knows the indexed commit, else by
    hashes of all its files. current: relative_path, content_hash, line_count of the unit's source files."""
    indexed = store.table("files", [r for r in store.manifest() if r[1] == root and r[2] == adapter])
    commit = store.commit_of(root, adapter)
    if commit and git.is_repository(root):
        try:
            spark = store.spark
            return git_freshness(indexed, current, git.diff(spark, root, commit), git.changed(spark, root, commit), git.untracked(spark, root))
        except git.GitError:
            pass  # the commit is gone, as after a rebase: the files themselves say it
    return freshness(changes(indexed, current))
