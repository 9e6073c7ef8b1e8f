"""Source trees end to end: edges by line and column, an index in a store, its search, freshness and renewal."""

import subprocess

import pytest
from pyspark.sql import functions as F
from test_sources import field, varint

from symgraph import chunkers, cli
from symgraph.adapters import ADAPTERS
from symgraph.functions import text as fx
from symgraph.operators import call_edges, embedding, freshness, retrieval, tree
from symgraph.operators.build import StoredIndex
from symgraph.operators.tables import Store
from symgraph.plans.router import Router
from symgraph.sources import git, scip
from symgraph.streaming import incremental

OCC = (
    "file_path string, symbol string, start_line int, start_col int, end_line int, end_col int, enclosing_start_line int, enclosing_start_col int, "
    "enclosing_end_line int, enclosing_end_col int, syntax_kind string, is_definition boolean, is_import boolean, is_read boolean, is_write boolean, doc_ord int, occ_ord int"
)


def occurrences(spark, path, rows):
    """rows: symbol, range, enclosing range, roles by their first letters."""
    out = [(path, s, *r, *e, "identifier", "d" in k, "i" in k, "r" in k, "w" in k, 0, n) for n, (s, r, e, k) in enumerate(rows)]
    return spark.createDataFrame(out, OCC)


def chunked(spark, path, source, primary):
    """The chunks of a file; primary names the symbols of some by kind and name."""
    rows = [c | {"primary_symbol": primary.get((c["kind"], c["name"]))} for c in chunkers.extract(path, source)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], chunkers.SCHEMA + ", primary_symbol string")


TS = b"""import { dep } from "./dep";

class Service {}

function run() {
  const service = new Service();
  const value = dep.load();
  return value;
}
"""


def test_typescript_edges(spark):
    chunks = chunked(spark, "example.ts", TS, {("module", "example.ts"): "example.ts", ("function_declaration", "run"): "example.ts/run().", ("class_declaration", "Service"): "example.ts/Service#"})
    occ = occurrences(spark, "example.ts", [
        ("pkg dep", (0, 9, 0, 12), (0, 0, 0, 28), "i"), ("example.ts/Service#", (2, 6, 2, 13), (2, 0, 2, 15), "d"), ("example.ts/run().", (4, 9, 8, 1), (4, 0, 8, 1), "d"),
        ("local service", (5, 8, 5, 15), (5, 2, 5, 32), "dw"), ("example.ts/Service#", (5, 22, 5, 29), (5, 2, 5, 32), "r"), ("local value", (6, 8, 6, 13), (6, 2, 6, 27), "dw"),
        ("pkg dep/load().", (6, 16, 6, 24), (6, 2, 6, 27), "r"), ("local value", (7, 9, 7, 14), (7, 2, 7, 15), "r"),
    ])
    symbols = spark.createDataFrame([("example.ts/Service#", "class")], "scip_symbol string, kind string")
    sites = call_edges.sites(spark.createDataFrame([("example.ts", TS)], "relative_path string, content binary"), "typescript")
    got = {tuple(r) for r in tree.occurrence_edges(chunks, occ, ("import_statement",)).collect()} | {tuple(r) for r in call_edges.call_edges(sites, occ, chunks, symbols).collect()}
    run = "example.ts/run()."
    assert {("example.ts", "pkg dep", "imports"), (run, "local value", "defines"), (run, "local value", "returns"), (run, "example.ts/Service#", "instantiates"), (run, "pkg dep/load().", "calls")} <= got
    assert not any(kind == "calls" and dst == run for _, dst, kind in got)


def test_typescript_sites():
    source = b"class A extends B {\n  constructor(x) { super(x) }\n  go(y: string): void { if (y) { this.run(y) } }\n}\nconst f = async (z) => { await z.load<T>(1).then(g); return new a.B(z) }\n// call(no)\nfunction h(x) { for (;;) { x?.go(); } }\n"
    lines = source.decode().split("\n")
    text = lambda s: lines[s[1]][s[2] : s[4]] if s[1] == s[3] else None
    sites = chunkers.brace_sites(source)
    assert {text(s) for s in sites if s[0] == "call"} == {"super", "this.run", "z.load<T>", "z.load<T>(1).then", "x?.go"}
    assert [text(s) for s in sites if s[0] == "new"] == ["new a.B(z)"] and [text(s) for s in sites if s[0] == "return"] == ["return new a.B(z) "]


def test_links_hold_primary_symbols_and_columns(spark):
    chunk = "file_path string, chunk_key string, kind string, start_line int, start_col int, end_line int, end_col int, start_byte int, end_byte int, primary_symbol string"
    chunks = spark.createDataFrame([("svc.py", "handler", "function_definition", 10, 0, 20, 0, 0, 9, "pkg handler()")], chunk)
    occ = occurrences(spark, "svc.py", [("dep client", (12, 4, 12, 10), (12, 4, 12, 10), "r"), ("dep config", (13, 4, 13, 10), (13, 4, 13, 10), "w")])
    got = {(r.symbol, r.role): r.weight for r in tree.chunk_symbol_links(chunks, occ).collect()}
    assert got == {("pkg handler()", "defines"): 1.0, ("dep client", "reads"): 0.6, ("dep client", "uses"): 0.55, ("dep config", "writes"): 0.75, ("dep config", "uses"): 0.55}
    # Two functions on one line: each has its own occurrences.
    chunks = spark.createDataFrame([("a.js", "f", "function", 0, 0, 0, 20, 0, 20, "f"), ("a.js", "g", "function", 0, 21, 0, 40, 21, 40, "g")], chunk)
    occ = occurrences(spark, "a.js", [("x", (0, 5, 0, 6), (0, 5, 0, 6), "r"), ("y", (0, 30, 0, 31), (0, 30, 0, 31), "r"), ("z", (0, 18, 0, 24), (0, 18, 0, 24), "r")])
    assert {(r.chunk_key, r.symbol) for r in tree.chunk_symbol_links(chunks, occ).collect()} == {("f", "f"), ("f", "x"), ("g", "g"), ("g", "y")}
    assert {tuple(r) for r in tree.occurrence_edges(chunks, occ, ()).collect()} == {("f", "x", "reads"), ("g", "y", "reads")}


@pytest.mark.parametrize(
    ("path", "clean", "inside"),
    [("a/b/c/d/e/../../../../../../x", "../x", False), ("a/./b//c", "a/b/c", True), ("a/..", ".", True), ("../a", "../a", False), ("/etc/x", "/etc/x", False), ("a\\b\\..\\c", "a/c", True), ("/../a", "/a", False), ("a/b/../../..", "..", False)],
)
def test_paths(spark, path, clean, inside):
    row = spark.createDataFrame([(path,)], "p string").select(fx.clean_path(F.col("p")).alias("c")).select("c", fx.inside_root(F.col("c"))).first()
    assert tuple(row) == (clean, inside)


ZOO = "class Animal:\n    def sound(self):\n        return None\n\n\nclass Dog(Animal):\n    def sound(self):\n        return bark()\n\n\ndef bark():\n    return 'woof'\n"
MAIN = "from zoo import Dog\n\n\ndef main():\n    dog = Dog()\n    return dog.sound()\n"


def ranged(*r):
    return field(1, b"".join(map(varint, r)))


def occurs(symbol, r, roles=0, around=None):
    return field(2, ranged(*r) + field(2, symbol) + (field(3, roles) if roles else b"") + field(5, 6) + (field(7, b"".join(map(varint, around))) if around else b""))


def record(symbol, kind, name, doc="", inside="", relation=b"", signature=""):
    return field(3, field(1, symbol) + (field(3, doc) if doc else b"") + relation + field(5, kind) + field(6, name) + (field(7, field(5, signature)) if signature else b"") + (field(8, inside) if inside else b""))


def artifact(shift=0):
    """The symbol index of ZOO and MAIN; shift: lines that went in front of main.py's function."""
    implements = field(4, field(1, "zoo/Animal#") + field(3, 1))
    zoo = field(1, "zoo.py") + field(4, "python")
    zoo += occurs("zoo/Animal#", (0, 6, 12), 1, (0, 0, 2, 19)) + occurs("zoo/Animal#sound().", (1, 8, 13), 1, (1, 4, 2, 19))
    zoo += occurs("zoo/Dog#", (5, 6, 9), 1, (5, 0, 7, 21)) + occurs("zoo/Animal#", (5, 10, 16), 8) + occurs("zoo/Dog#sound().", (6, 8, 13), 1, (6, 4, 7, 21))
    zoo += occurs("zoo/bark().", (7, 15, 19), 8) + occurs("zoo/bark().", (10, 4, 8), 1, (10, 0, 11, 17))
    zoo += record("zoo/Animal#", 7, "Animal", "```python\nclass Animal\n```\nAn animal.") + record("zoo/Dog#", 7, "Dog", relation=implements)
    zoo += record("zoo/Animal#sound().", 26, "sound", inside="zoo/Animal#") + record("zoo/Dog#sound().", 26, "sound", inside="zoo/Dog#", signature="def sound(self)") + record("zoo/bark().", 17, "bark")
    main = field(1, "./main.py") + field(4, "python") + occurs("zoo/Dog#", (0, 16, 19), 2)
    main += occurs("main/main().", (3 + shift, 4, 8), 1, (3 + shift, 0, 5 + shift, 22)) + occurs("zoo/Dog#", (4 + shift, 10, 13), 8) + occurs("zoo/Dog#sound().", (5 + shift, 15, 20), 8)
    main += record("main/main().", 17, "main")
    escape = field(1, "../outside.py") + occurs("x/y.", (0, 0, 1), 1)
    return field(2, zoo) + field(2, main) + field(2, escape)


class Lengths:
    """Vectors of texts' lengths; counts what it is asked for."""

    asked = 0

    def embed(self, texts):
        Lengths.asked = texts.where("owner_type = 'chunk'").count()
        return texts.select("owner_type", "owner_key", F.array(F.octet_length("text").cast("float"), F.lit(1.0).cast("float")).alias("vector"))


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    (root / ".symgraph").mkdir(parents=True)
    for name, text in (("pyproject.toml", ""), ("zoo.py", ZOO), ("main.py", MAIN), ("__init__.py", ""), ("notes.txt", "n")):
        (root / name).write_text(text)
    (root / ".symgraph/python-scip.scip").write_bytes(artifact())
    return root


def test_tree_is_indexed_and_searched(spark, project, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    status = cli.index_tree(store, str(project)).collect()
    assert [(r.adapter_id, r.n_files, r.n_occurrences) for r in status] == [("python-scip", 2, 11)]
    index = StoredIndex(store, str(project))
    primary = {(r.file_path, r.kind, r.name, r.start_line): r.primary_symbol for r in index.chunks.collect()}
    assert primary["zoo.py", "function_definition", "sound", 1] == "zoo/Animal#sound()." and primary["zoo.py", "function_definition", "sound", 6] == "zoo/Dog#sound()."
    assert primary["main.py", "function_definition", "main", 3] == "main/main()." and primary["zoo.py", "class_definition", "Dog", 5] == "zoo/Dog#"
    edges = {(r.src_symbol, r.dst_symbol, r.kind) for r in index.edges.collect()}
    assert {("zoo/Dog#", "zoo/Animal#", "implementation"), ("zoo/Dog#", "zoo/Dog#sound().", "contains"), ("zoo/Dog#sound().", "zoo/bark().", "reads"), ("zoo/Dog#sound().", "zoo/bark().", "calls"), ("zoo/Dog#sound().", "zoo/bark().", "returns"), ("main/main().", "zoo/Dog#", "instantiates"), ("main/main().", "zoo/Dog#sound().", "calls")} <= edges
    assert not any(s == d for s, d, kind in edges if kind != "imports")
    text = {r.primary_symbol: r.retrieval_text for r in index.chunks.where("kind <> 'module'").collect()}
    assert text["zoo/Dog#"].startswith("Dog is a class definition in zoo.py. Implements Animal. Uses Dog, Animal, sound, bark.\n\nclass Dog")
    assert text["zoo/Dog#sound()."].startswith("sound is a function definition in zoo.py. Signature: def sound(self). Defined inside Dog. Uses sound, bark.\n\n")
    assert text["zoo/Animal#"].startswith("Animal is a class definition in zoo.py. class Animal An animal. Uses Animal, sound.\n\n")
    router = Router(index)
    found = router.definition("bark").first()
    assert (found.scip_symbol, found.def_line, found.ambiguous, found.start_line) == ("zoo/bark().", 10, False, 10)
    assert router.definition("sound").first().ambiguous and router.candidates("sound").count() == 2 and router.candidates("bark").count() == 0
    assert [(r.abs_path, r.line) for r in router.references("Dog").collect()] == [(f"{project}/main.py", 0), (f"{project}/main.py", 4)]
    assert {r.primary_symbol for r in router.search("bark", 5, "graph").collect()} >= {"zoo/bark().", "zoo/Dog#sound()."}
    for mode in ("auto", "hybrid", "symbol", "graph"):
        assert router.search("bark", 5, mode).orderBy("rank").first().primary_symbol == "zoo/bark()."
    assert router.search("bark", 5, "semantic").count() == 0 and router.search("woof", 5).count() > 0
    context = router.context("bark", 5)
    assert context["seed"].first().name == "bark" and context["definition"].count() == 1 and context["references"].count() == 1
    with pytest.raises(LookupError):
        router.context("nothing_of_the_kind", 5)
    with pytest.raises(FileNotFoundError):
        tree.build(store, tree.Source(str(project), ADAPTERS["python-scip"], scip.read(spark, f"file://{project}/.symgraph/*.scip"), spark.createDataFrame([("zoo.py", b"")], "relative_path string, content binary")))


def test_renewal_chunks_changed_files_and_keeps_vectors(spark, project, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")

    def sources():
        ((_, source),) = cli.units_of(spark, str(project))
        source.provider, source.model = Lengths(), "lengths"
        return source

    tree.build(store, sources())
    first = {r.owner_key: list(r.vector) for r in store.table("embeddings").collect()}
    chunks = store.table("chunks").count()
    assert Lengths.asked == chunks and len(first) == chunks + store.table("symbols").count()
    assert StoredIndex(store, str(project)).has_vectors
    hits = Router(StoredIndex(store, str(project)), lambda q: [60.0, 1.0]).search("bark", 5, "semantic")
    assert hits.count() > 0
    (project / "main.py").write_text("# one\n# two\n" + MAIN)
    (project / ".symgraph/python-scip.scip").write_bytes(artifact(2).replace(ranged(0, 16, 19), ranged(2, 16, 19)))
    assert tree.reindex(store, sources()) == 1
    keys = {r.chunk_key for r in store.table("chunks").collect()}
    assert len(keys) == chunks and any(k.startswith("main.py:12:") or k.startswith("main.py:") for k in keys)
    assert {r.file_path for r in store.table("chunks").where("start_line > 0 AND kind = 'function_definition'").collect()} == {"zoo.py", "main.py"}
    vectors = {r.owner_key: list(r.vector) for r in store.table("embeddings").where("owner_type = 'chunk'").collect()}
    assert set(vectors) == keys and 0 < Lengths.asked <= 3
    whole = {r.chunk_key: r.retrieval_text for r in store.table("chunks").collect()}
    tree.build(store, sources())
    assert whole == {r.chunk_key: r.retrieval_text for r in store.table("chunks").collect()}


def commit(root, *names):
    for args in (["add", *names], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)


def test_freshness_by_git_then_by_hashes(spark, project, tmp_path):
    subprocess.run(["git", "-C", str(project), "init", "-q"], check=True)
    commit(project, ".")
    store = Store(spark, f"file://{tmp_path}/store")
    cli.index_tree(store, str(project))

    def fresh():
        ((adapter, source),) = cli.units_of(spark, str(project))
        return freshness.of_unit(store, source.root, adapter, source.files)

    row = fresh().first()
    assert (row.status, row.n_indexed, row.changed_lines) == ("clean", 2, 0) and store.commit_of(str(project)) == git.head(str(project))
    (project / "notes.txt").write_text("other\nlines\n")
    assert fresh().first().status == "clean"  # no source file
    (project / "zoo.py").write_text(ZOO.replace("woof", "wuff"))
    row = fresh().first()
    assert (row.n_dirty, row.changed_lines, row.status) == (1, 2, "stale") and row.line_ratio == pytest.approx(2 / row.total_lines)
    (project / "zoo.py").write_text(ZOO)
    (project / "neu ä.py").write_text("a = 1\nb = 2\n")
    row = fresh().first()
    assert (row.n_new, row.changed_lines) == (1, 2)
    (project / "neu ä.py").unlink()
    subprocess.run(["git", "-C", str(project), "mv", "main.py", "moved.py"], check=True)
    row = fresh().first()
    assert (row.n_missing, row.n_new, row.changed_lines, row.status) == (1, 1, 0, "clean")  # a rename alone changes no line
    store.update(str(project), "python-scip", spark.createDataFrame([], "relative_path string"), {"projects": store.table("projects").withColumn("git_commit_hash", F.lit("0" * 40)).drop("root_path", "adapter_id")})
    row = fresh().first()  # a commit that git doesn't know: by hashes
    # The tree has an empty file that the symbol index hasn't.
    assert (row.n_missing, row.n_new, row.status) == (1, 2, "stale") and row.changed_lines == 2 * 6
    with pytest.raises(git.GitError):
        git.diff(spark, str(project), "0" * 40)


def test_refresh_before_a_search(spark, project, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    cli.index_tree(store, str(project))
    assert cli.refresh(store, str(project)) == []
    (project / "main.py").write_text(MAIN + "# end\n")
    assert cli.refresh(store, str(project)) == ["indexed again"] and cli.refresh(store, str(project)) == []
    assert "python-scip" in cli.summary(store.status())


def test_store_keeps_what_it_should(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = lambda *names: spark.createDataFrame([(n, "h" + n, 1) for n in names], "relative_path string, content_hash string, line_count int")
    chunks = lambda *names: spark.createDataFrame([(n, n.split(":")[0]) for n in names], "chunk_key string, file_path string")
    vectors = lambda *names: spark.createDataFrame([("chunk", n, [1.0]) for n in names] + [("symbol", "s", [2.0])], "owner_type string, owner_key string, vector array<float>")
    project = spark.createDataFrame([("p", "abc")], "name string, git_commit_hash string")
    store.replace("/r", "a", {"projects": project, "files": files("x", "y"), "chunks": chunks("x:1", "x:2", "y:1"), "embeddings": vectors("x:1", "x:2", "y:1")})
    assert {(r.root_path, r.adapter_id) for r in store.table("files").collect()} == {("/r", "a")}  # keys that the rows hadn't
    store.update("/r", "a", files("x").select("relative_path"), {"files": files("x"), "chunks": chunks("x:1")})
    assert {r.owner_key for r in store.table("embeddings").collect()} == {"x:1", "y:1", "s"}  # none of chunks that are gone
    store.replace("/r", "a", {"files": files("z")})
    assert store.commit_of("/r") == "abc" and store.table("chunks").count() == 0  # the project stays, what hung on its files goes
    for _ in range(20):
        store.log_run("/r", "a", spark.createDataFrame([("ok",)], "status string"))
    assert store.table("index_runs").count() == 20 and sum(r[0] == "index_runs" for r in store.manifest()) <= 16
    before = store.table("files").collect()
    assert store.vacuum() > 0 and store.vacuum() == 0 and store.table("files").collect() == before
    base = store.manifest()
    store.replace("/r", "a", {"files": files("other")})
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(lambda rows: rows, ("/r", "a"), base)


def test_embeddings_without_a_model(spark):
    texts = spark.createDataFrame([("chunk", "k", "t")], "owner_type string, owner_key string, text string")
    assert embedding.NoProvider().embed(texts).count() == 0


def test_a_stream_chunks_what_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    versions = lambda *rows: spark.createDataFrame(rows, "relative_path string, text string, version long, deleted boolean")
    incremental.apply_batch(store, "/r", "python", versions(("a.py", "def f(): pass\n", 1, False), ("b.py", "x = 1\n", 1, False)))
    incremental.apply_batch(store, "/r", "python", versions(("a.py", "def g(): pass\n", 2, False), ("b.py", None, 2, True)))
    got = {(r.file_path, r.kind, r.name) for r in store.table("chunks").collect()}
    assert got == {("a.py", "module", "a.py"), ("a.py", "function_definition", "g")}
    assert retrieval.search_chunks(StoredIndex(store, "/r").chunks, "def g", 3).first().name == "g"


def test_runs_are_logged(spark, project, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ((_, source),) = cli.units_of(spark, str(project))

    def fails(*_):
        raise ValueError("no such thing")

    with pytest.raises(ValueError, match="no such thing"):
        cli.logged(store, source, fails)
    cli.logged(store, source, tree.build)
    runs = {r.status: r for r in store.table("index_runs").collect()}
    assert runs["error"].error_text == "no such thing" and runs["ok"].files_indexed == 2 and runs["ok"].started_at < runs["ok"].completed_at
