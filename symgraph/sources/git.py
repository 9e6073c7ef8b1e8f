"""Lists and diffs of a git repository, read on the driver and handed on as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


class GitError(RuntimeError):
    """A git command that failed, with what it said."""


def _git(root: str, *args: str) -> str:
    """Paths come as they are, whatever characters they have."""
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", *args], capture_output=True, text=True)
    if done.returncode != 0:
        raise GitError(f"git {' '.join(args)}: {done.stderr.strip()}")
    return done.stdout


def is_repository(root: str) -> bool:
    try:
        return _git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (GitError, FileNotFoundError):
        return False


def head(root: str) -> str:
    """The commit, or nothing before the first one."""
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except GitError:
        return ""


def _paths(spark: SparkSession, paths) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted({x for x in paths if x})], "relative_path string")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Tracked files and untracked ones that aren't ignored: relative_path."""
    return _paths(spark, _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0"))


def untracked(spark: SparkSession, root: str) -> DataFrame:
    return _paths(spark, _git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0"))


def diff(spark: SparkSession, root: str, since: str) -> DataFrame:
    """path (renames in the diff's form), added, deleted since a commit; binary files count no lines. A commit
    that git doesn't know is an error."""
    rows = [x.split("\t", 2) for x in _git(root, "diff", "--numstat", "--relative", "-M", since).splitlines() if x.count("\t") >= 2]
    number = lambda x: int(x) if x.isdigit() else 0
    return spark.createDataFrame([(p, number(a), number(d)) for a, d, p in rows], "path string, added long, deleted long")


def changed(spark: SparkSession, root: str, since: str) -> DataFrame:
    """Paths that changed since a commit; a rename has both."""
    lines = _git(root, "diff", "--name-status", "--relative", "-M", since).splitlines()
    return _paths(spark, (p for x in lines for p in x.split("\t")[1:]))
