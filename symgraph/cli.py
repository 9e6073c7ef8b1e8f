"""Commands: index a source tree or a corpus of documents, status, search, def, refs, context."""

from __future__ import annotations

import argparse
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import ADAPTERS, detected
from .functions import text as fx
from .operators import freshness, ranking, tree
from .operators.build import CORPUS_ADAPTER, StoredIndex, store_corpus
from .operators.tables import Store
from .plans.router import DEFAULT_LIMIT, MODES, Router
from .session import session
from .sources import files as fs
from .sources import git, scip
from .sources.corpus import Corpus, root_of

RUN = "started_at timestamp, completed_at timestamp, status string, files_indexed long, symbols_indexed long, chunks_indexed long, error_text string"
#: Rows of a listing that are printed at most; a status has a row a project.
SHOWN = 1000


def units_of(spark: SparkSession, root: str) -> list[tuple[str, tree.Source]]:
    """A tree's units as sources, each with its files' content: in a repository what git lists, elsewhere all that the
    ignore file doesn't name. A unit's symbol index is <adapter>.scip in the state folder of the unit; units
    without one are passed over."""
    files, rules = fs.tree(spark, f"file://{root}"), []
    if git.is_repository(root):
        files = files.join(git.listed(spark, root), "relative_path", "left_semi")
    else:
        for r in files.where("relative_path = '.gitignore'").select(F.decode("content", "UTF-8")).collect():
            rules = fs.ignore_rules(r[0])
    out = []
    for folder, adapter_id, manifest in detected(files):
        adapter = ADAPTERS[adapter_id]
        top = f"{root}/{folder}".rstrip("/")
        artifact = f"{top}/{fs.STATE}/{adapter_id}.scip"
        own = files if not folder else files.where(F.col("relative_path").startswith(folder + "/")).withColumn("relative_path", F.substring("relative_path", len(folder) + 2, 1 << 20))
        own = adapter.source_files(own, rules)
        if os.path.exists(artifact):
            project = {"manifest_path": f"{top}/{manifest}", "scip_artifact_path": artifact, "git_commit_hash": git.head(top) if git.is_repository(top) else None}
            out.append((adapter_id, tree.Source(top, adapter, scip.read(spark, f"file://{artifact}"), own, project=project)))
    return out


def logged(store: Store, source: tree.Source, run) -> None:
    """Builds a unit's index and logs the run with its counts, or with what went wrong."""
    began, adapter_id = datetime.now(UTC), source.adapter.id

    def log(status: str, counts: dict[str, int], error: str | None = None) -> None:
        row = (began, datetime.now(UTC), status, counts.get("n_files"), counts.get("n_symbols"), counts.get("n_chunks"), error)
        store.log_run(source.root, adapter_id, store.spark.createDataFrame([row], RUN))

    try:
        run(store, source)
    except Exception as e:
        log("error", {}, str(e)[:1000])
        raise
    log("ok", store.status().where((F.col("root_path") == source.root) & (F.col("adapter_id") == adapter_id)).first().asDict())


def index_tree(store: Store, root: str, incremental: bool = True) -> DataFrame:
    """All units of a tree into a store: those that were indexed before only where files changed. Projects that
    are no longer there go. Returns status()."""
    found = units_of(store.spark, root)
    if not found:
        raise LookupError(f"no unit below {root} has a symbol index")
    for adapter_id, source in found:
        known = any(r[1:3] == (source.root, adapter_id) for r in store.manifest())
        logged(store, source, tree.reindex if known and incremental else tree.build)
    store.drop_stale(root, [adapter_id for adapter_id, _ in found])
    return store.status()


def refresh(store: Store, root: str) -> list[str]:
    """What a search does first: units that changed much are indexed anew, a little: a warning is returned."""
    warnings, again = [], False
    for adapter_id, source in units_of(store.spark, root):
        now = source.files.select("relative_path", "content_hash", "line_count")
        row = freshness.of_unit(store, source.root, adapter_id, now).first()
        if row.line_ratio >= freshness.REINDEX_RATIO:
            tree.reindex(store, source)
            again = True
        elif row.line_ratio >= freshness.WARN_RATIO:
            warnings.append(f"{source.root} ({adapter_id}): {row.changed_lines} of {row.total_lines} lines have changed since it was indexed")
    return warnings + (["indexed again"] if again else [])


def summary(status: DataFrame) -> str:
    """Projects with their counts and the totals, as lines."""
    rows = status.limit(SHOWN).collect()
    counts = ("n_files", "n_symbols", "n_occurrences", "n_chunks")
    lines = ["\t".join([r.root_path, r.adapter_id, *(f"{r[c]:,}" for c in counts)]) for r in rows]
    return "\n".join(["\t".join(["root", "adapter", *(c[2:] for c in counts)]), *lines, "\t".join(["total", "", *(f"{sum(r[c] for r in rows):,}" for c in counts)])])


def shown(hits: DataFrame, with_scores: bool) -> DataFrame:
    """Hits with labels; scores and probabilities only where they are asked for."""
    columns = [fx.kind_label(F.col("kind")).alias("kind"), "name", "abs_path", "start_line", "end_line"]
    return hits.orderBy("rank").select(*columns, *(["score", "probability"] if with_scores else []))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="symgraph")
    p.add_argument("command", choices=("index", "status", "search", "def", "refs", "context"))
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--store", required=True)
    p.add_argument("--root", default="", help="a source tree")
    p.add_argument("--data", default="", help="folder of a corpus' tables")
    p.add_argument("--source", default="src0")
    p.add_argument("--adapter")
    p.add_argument("--mode", choices=MODES, default="auto")
    p.add_argument("--limit", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--scores", action="store_true")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--no-refresh", action="store_true")
    args = p.parse_args(argv)
    spark = session()
    store = Store(spark, args.store)
    root = os.path.abspath(args.root) if args.root else root_of(args.source)
    limit = DEFAULT_LIMIT if args.limit is None else args.limit
    if args.command == "index":
        if args.root:
            print(summary(index_tree(store, root)))
            return
        store_corpus(Corpus(spark, args.data, args.source), store, root)
        store.log_run(root, CORPUS_ADAPTER, spark.range(1).select(F.current_timestamp().alias("completed_at"), F.lit("ok").alias("status")))
        print(summary(store.status()))
        return
    if args.command == "status":
        if args.json:
            print("\n".join(store.status().limit(SHOWN).toJSON().collect()))
        else:
            print(summary(store.status()))
        return
    if args.root and not args.no_refresh:
        for line in refresh(store, root):
            print(line)
    router = Router(StoredIndex(store, root, args.adapter))
    if args.command == "context":
        for name, part in router.context(args.query, limit, args.mode).items():
            print(name)
            part.show(limit, truncate=80)
        return
    if args.command == "search":
        hits = router.search(args.query, limit, args.mode)
        out = shown(ranking.clipped(hits) if args.limit is None else hits, args.scores)
    elif args.command == "def":
        out = router.definition(args.query)
        candidates = router.candidates(args.query).select("display_name", "scip_symbol", "kind", "abs_path", "def_line", "signature")
        if not args.json:
            candidates.show(limit, truncate=80)
            router.relations(args.query, limit).select("relation_kind", "direction", "chunk_key").show(limit, truncate=80)
    else:
        out = router.references(args.query, 3 if args.limit is None else limit)
    if args.explain:
        out.explain("formatted")
    if args.json:
        print("\n".join(out.limit(max(limit, 1)).toJSON().collect()))
    else:
        out.show(limit, truncate=80)


if __name__ == "__main__":
    main()
