"""Operators on fixtures small enough to follow by hand."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions.scoring import LINK_WEIGHTS
from symgraph.operators import call_edges, derive, freshness, intervals, ranking, retrieval
from symgraph.operators.tables import Store
from symgraph.plans.router import plan_of
from symgraph.sources import files as fs


def test_interval_join_finds_each_pair_once(spark):
    import random

    rng = random.Random(1)
    points = [(k % 3, rng.randrange(300), k) for k in range(400)]
    spans = [(k % 3, a := rng.randrange(300), a + rng.randrange(150), k) for k in range(60)]
    got = intervals.interval_join(spark.createDataFrame(points, "f int, line int, p int"), spark.createDataFrame(spans, "f int, start_line int, end_line int, s int"), ["f"])
    expected = sorted((p, s) for f, x, p in points for g, a, b, s in spans if f == g and a <= x <= b)
    assert sorted((r.p, r.s) for r in got.collect()) == expected


def test_links_of_reads_and_writes(spark):
    chunks = spark.createDataFrame([(1, "handler", 10, 20)], "doc_id int, chunk_key string, start_line int, end_line int")
    occ = spark.createDataFrame(
        [(1, 12, 4, "client", False, False, False, True, "identifier"), (1, 13, 4, "config", False, False, True, False, ""), (1, 10, 1, "handler()", True, False, False, False, ""), (1, 30, 0, "out", False, False, False, False, "")],
        "doc_id int, line int, col int, symbol string, is_definition boolean, is_import boolean, is_write boolean, is_read boolean, syntax_kind string",
    )
    got = {(r.symbol, r.role): r.weight for r in derive.chunk_symbol_links(chunks, occ).collect()}
    assert got == {("handler()", "defines"): 1.0, ("client", "reads"): 0.6, ("client", "uses"): 0.55, ("config", "writes"): 0.75}
    assert LINK_WEIGHTS["imports"] == 0.65


def test_primary_symbol_by_name_then_order(spark):
    chunks = spark.createDataFrame([(1, "a", "run", 0, 9), (1, "b", "", 0, 9), (1, "c", "none", 5, 5)], "doc_id int, chunk_key string, name string, start_line int, end_line int")
    defs = spark.createDataFrame([(1, 3, 0, "first"), (1, 4, 0, "run")], "doc_id int, line int, col int, symbol string")
    assert {r.chunk_key: r.primary_symbol for r in derive.primary_symbols(chunks, defs).collect()} == {"a": "run", "b": "first"}


def test_parents(spark):
    rows = [(1, "m", 0, 9, 0, 100), (1, "f", 0, 4, 0, 50), (1, "same1", 6, 6, 60, 70), (1, "same2", 6, 6, 60, 70), (1, "empty", 5, 5, 55, 55)]
    got = derive.parents(spark.createDataFrame(rows, "doc_id int, chunk_key string, start_line int, end_line int, start_byte int, end_byte int")).collect()
    assert {r.chunk_key: r.parent_key for r in got} == {"m": None, "f": "m", "same1": "same2", "same2": "same1", "empty": "m"}


SYMBOLS = "display_name string, scip_symbol string, kind string, abs_path string, def_line int, doc_summary string, signature string, root_path string"


def test_resolution_prefers_exact_names(spark):
    rows = [("sound", "Animal#sound()", "method", "/animal.py", 1, "", "", "r"), ("sound", "Dog#sound()", "method", "/dog.py", 1, "", "", "r"), ("soundly", "s", "function", "/tests/x.py", 1, "", "", "r")]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    found = retrieval.find_definitions(symbols, "sound", 8)
    assert [r.scip_symbol for r in found.orderBy("rank").collect()] == ["Animal#sound()", "Dog#sound()", "s"]
    out = ranking.resolved_definition(found, "sound").collect()[0]
    assert out.scip_symbol == "Animal#sound()" and out.ambiguous
    out = ranking.resolved_definition(retrieval.find_definitions(symbols, "Dog#sound()", 8), "Dog#sound()").collect()[0]
    assert out.scip_symbol == "Dog#sound()" and not out.ambiguous
    assert ranking.resolved_definition(retrieval.find_definitions(symbols, "nothing", 8), "nothing").count() == 0


def test_reference_family_goes_both_ways(spark):
    edges = spark.createDataFrame([("Dog", "Animal", "reference"), ("Cat", "Animal", "reference"), ("Animal", "Base", "reference"), ("X", "Animal", "calls")], "src_symbol string, dst_symbol string, kind string")
    occ = spark.createDataFrame([(1, 5, 2, "Animal", False), (2, 8, 2, "Dog", False), (2, 1, 0, "Dog", True), (3, 0, 0, "X", False)], "doc_id int, line int, col int, symbol string, is_definition boolean")
    occ = occ.withColumn("root_path", F.lit("/r")).withColumn("syntax_kind", F.lit("identifier"))
    seeds = spark.createDataFrame([("Animal",)], "symbol string")
    assert {r.symbol for r in retrieval.reference_family(edges, seeds).collect()} == {"Animal", "Dog", "Cat", "Base"}
    assert [(r.symbol, r.line) for r in retrieval.list_references(occ, edges, seeds).collect()] == [("Animal", 5), ("Dog", 8)]
    with pytest.raises(ValueError, match="blank"):
        retrieval.search_chunks(occ, " ", 3)


def test_floor_gate_and_clip(spark):
    hits = spark.createDataFrame([(k, 1 / s - 1) for k, s in enumerate((0.50, 0.42, 0.34, 0.10))], "rank int, distance double")
    assert ranking.above_floor(hits).count() == 2
    assert not ranking.passes_gate(0, 0.45, 1) and ranking.passes_gate(1, 0.45, 1) and ranking.passes_gate(0, 0.45, 2) and not ranking.passes_gate(0, None, 2)
    probabilities = lambda *p: spark.createDataFrame(list(enumerate(map(float, p))), "rank int, probability double")
    assert [r.probability for r in ranking.clipped(probabilities(0.95, 0.004, 0.003, 0.003, 0.002)).collect()] == [1.0]
    assert sorted(r.probability for r in ranking.clipped(probabilities(0.5, 0.3, 0.1, 0.1)).collect()) == [0.1, 0.1, 0.3, 0.5]
    assert [ranking.pool_size(n) for n in (0, 10, 20, 100)] == [60, 60, 120, 200]


def test_context_seed_is_the_function_not_the_module(spark):
    hits = spark.createDataFrame([("m", "module", "main.go", 8.0, 0, 3500, 0), ("f", "function_definition", "run", 4.5, 40, 68, 1)], "chunk_key string, kind string, name string, score double, start_line int, end_line int, rank int")
    assert ranking.context_seed(hits, "handle request", False).collect()[0].chunk_key == "f"


def test_modes():
    assert plan_of(None, "run") == plan_of("AUTO", "run")
    assert plan_of("auto", "two words").exact is False and plan_of("auto", "word").exact is True and plan_of("auto", "word").mode == "hybrid"
    assert not plan_of("symbol", "x").semantic and not plan_of("semantic", "x").exact and not plan_of("graph", "x").chunks
    with pytest.raises(ValueError, match="mode"):
        plan_of("fuzzy", "x")


def test_freshness(spark):
    row = "relative_path string, content_hash string, line_count int"
    indexed = spark.createDataFrame([("a", "1", 10), ("b", "2", 20), ("c", "3", 5)], row)
    current = spark.createDataFrame([("a", "1", 10), ("b", "9", 30), ("d", "4", 2)], row)
    changed = freshness.changes(indexed, current)
    assert {r.relative_path: (r.state, r.changed_lines) for r in changed.collect()} == {"a": ("clean", 0), "b": ("dirty", 30), "c": ("missing", 5), "d": ("new", 2)}
    out = freshness.freshness(changed).collect()[0]
    assert (out.n_new, out.n_missing, out.n_dirty, out.changed_lines, out.total_lines, out.status) == (1, 1, 1, 37, 42, "stale")
    assert out.changed_ratio == 1.0 and out.line_ratio == pytest.approx(37 / 42)
    ratios = spark.createDataFrame([(0.18,), (0.22,), (0.02,), (0.14,), (0.15,)], "r double").select(freshness.decision(F.col("r"), F.lit(True))).collect()
    assert [r[0] for r in ratios] == ["warn", "reindex", "none", "none", "warn"]
    assert freshness.freshness(freshness.changes(indexed, indexed)).collect()[0].status == "clean"
    diff = spark.createDataFrame([("a/{x => y}/f", 3, 1), ("gone => there", 2, 0), ("other", 9, 9)], "path string, added int, deleted int")
    got = freshness.diff_stats(diff, spark.createDataFrame([("a/y/f",), ("gone",), ("there",)], "relative_path string")).collect()
    assert {r.relative_path: (r.added, r.deleted) for r in got} == {"a/y/f": (3, 1), "gone": (2, 0)}


def test_store_replaces_one_project_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.manifest() == [] and store.table("files").count() == 0 and store.status().count() == 0
    files = lambda *names: spark.createDataFrame([(n, "h" + n, 1) for n in names], "relative_path string, content_hash string, line_count int")
    project = spark.createDataFrame([("p", "abc")], "name string, git_commit_hash string")
    store.replace("/r", "python", {"projects": project, "files": files("a.py", "b.py")})
    store.replace("/r", "typescript", {"projects": project, "files": files("a.ts")})
    snapshot = store.manifest()
    store.replace("/r", "python", {"projects": project, "files": files("c.py")})
    assert {r.relative_path for r in store.table("files").collect()} == {"c.py", "a.ts"}
    assert {r.relative_path for r in store.table("files", snapshot).collect()} == {"a.py", "b.py", "a.ts"}
    store.update("/r", "typescript", files("a.ts").select("relative_path"), {"files": files("d.ts")})
    store.update("/r", "python", files("x.py").select("relative_path"), {"files": files("x.py")})
    assert {r.relative_path for r in store.table("files").collect()} == {"c.py", "x.py", "d.ts"}
    assert store.commit_of("/r") == "abc" and store.commit_of("/none") is None
    store.log_run("/r", "python", spark.createDataFrame([("ok",)], "status string"))
    assert [(r.adapter_id, r.n_files) for r in store.status().collect()] == [("python", 2), ("typescript", 1)]
    assert store.drop_stale("/r", ["python"]) == 1 and store.drop_stale("/r", ["python"]) == 0
    assert {r.relative_path for r in store.table("files").collect()} == {"c.py", "x.py"} and store.table("index_runs").count() == 1
    assert store.drop_stale("/", []) == 1 and store.table("files").count() == 0


def test_ignore_rules(spark):
    rules = fs.ignore_rules("# c\n\nbuild/\n*.gen.go\nsecret\ndocs/internal\n/\n")
    paths = ["build/a.go", "x/build/y", "a.gen.go", "a/b.gen.go", "secret", "a/secret/b", "docs/internal/x", "docs/internals", "docs/x", "gen.go"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(fs.ignored(F.col("p"), rules)).collect()]
    assert got == [True, True, True, True, True, True, True, False, False, False]
    assert fs.glob_regex("[!a]?.p*") == r"^[^a][^/]\.p[^/]*$"


def test_units_and_roots(spark):
    listing = spark.createDataFrame([(p,) for p in ("pyproject.toml", "setup.py", "go.mod", "sub/Cargo.toml", "node_modules/x/go.mod", "sub/deep/pom.xml")], "relative_path string")
    units = fs.units(listing)
    assert {(r.dir, r.adapter_id, r.manifest) for r in units.collect()} == {("", "python-scip", "pyproject.toml"), ("", "go-scip", "go.mod"), ("sub", "rust-scip", "Cargo.toml"), ("sub/deep", "java-scip", "pom.xml")}
    near = fs.nearest_unit(spark.createDataFrame([("sub/deep/er",)], "path string"), units).collect()
    assert {(r.adapter_id, r.dir) for r in near} == {("python-scip", ""), ("go-scip", ""), ("rust-scip", "sub"), ("java-scip", "sub/deep")}
    votes = spark.createDataFrame([("/a",), ("/a/b",), ("/a",), ("/a/b",), ("/c",)], "root string")
    assert fs.voted_root(votes).collect()[0].root == "/a/b"


def test_call_edges(spark):
    source = b"import dep\nclass Worker: pass\ndef run(x):\n    w = Worker()\n    dep.load(w)\n    return w\n"
    files = spark.createDataFrame([("a.py", source)], "relative_path string, content binary")
    sites = call_edges.python_sites(files)
    occ = [("Worker", 3, 8, 14, True), ("dep", 4, 4, 7, True), ("dep/load", 4, 8, 12, True), ("w", 4, 13, 14, True), ("w", 5, 11, 12, True), ("x", 5, 0, 1, True)]
    occ = spark.createDataFrame([("a.py", s, a, b, a, c, False, False, r) for s, a, b, c, r in occ], "file_path string, symbol string, start_line int, start_col int, end_line int, end_col int, is_definition boolean, is_import boolean, is_read boolean")
    chunks = spark.createDataFrame([("a.py", "m", "module", "a.py", 0, 6), ("a.py", "f", "function_definition", "run", 2, 5)], "file_path string, chunk_key string, kind string, primary_symbol string, start_line int, end_line int")
    symbols = spark.createDataFrame([("Worker", "class"), ("run", "function")], "scip_symbol string, kind string")
    got = {(r.src_symbol, r.dst_symbol, r.kind) for r in call_edges.call_edges(sites, occ, chunks, symbols).collect()}
    assert got == {("run", "Worker", "instantiates"), ("run", "dep", "calls"), ("run", "w", "returns")}
