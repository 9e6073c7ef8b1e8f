"""Sources on real bytes: symbol indexes, chunkers, trees, git, streams."""

import subprocess

import pytest
from pyspark.sql import functions as F

from symgraph import chunkers
from symgraph.operators import embedding
from symgraph.operators.tables import Store
from symgraph.sources import files as fs
from symgraph.sources import git, scip
from symgraph.streaming import incremental


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_symbol_index(spark, tmp_path):
    relation = field(1, "Animal#") + field(2, 1) + field(3, 1)
    dog = field(1, "py zoo/Dog#sound().") + field(3, "Doc one") + field(3, "two") + field(4, relation) + field(5, 26) + field(7, field(4, "py") + field(5, "def sound(self)")) + field(8, "Dog#")
    first = field(1, b"".join(map(varint, (5, 2, 7)))) + field(2, "py zoo/Dog#sound().") + field(3, 1) + field(5, 16)
    second = field(1, b"".join(map(varint, (8, 2, 9, 4)))) + field(2, "local 1") + field(3, 8) + field(5, 12) + field(7, b"".join(map(varint, (7, 0, 10, 0))))
    unpacked = field(1, 3) + field(1, 0) + field(1, 4) + field(2, "local 2") + field(3, 1)
    doc = field(1, "zoo.py") + field(2, first) + field(2, second) + field(2, unpacked) + field(3, dog) + field(4, "python")
    index = field(1, field(1, 0)) + field(2, doc) + field(3, field(1, "Animal#") + field(6, "Animal") + field(5, 7))
    (tmp_path / "x.scip").write_bytes(index)
    (tmp_path / "empty.scip").write_bytes(b"")
    docs = scip.read(spark, f"file://{tmp_path}/*.scip").cache()
    assert sorted((r.is_external, r.relative_path) for r in docs.collect()) == [(False, "zoo.py"), (True, "")]
    symbols = {r.scip_symbol: r for r in scip.symbols(docs).collect()}
    assert (symbols["py zoo/Dog#sound()."].display_name, symbols["py zoo/Dog#sound()."].kind) == ("sound", "method")
    assert symbols["py zoo/Dog#sound()."].doc_summary == "Doc one\ntwo" and symbols["py zoo/Dog#sound()."].signature == "def sound(self)"
    assert (symbols["Animal#"].display_name, symbols["Animal#"].kind) == ("Animal", "class")
    assert {(r.dst_symbol, r.kind) for r in scip.relationship_edges(docs).collect()} == {("Animal#", "reference"), ("Animal#", "implementation")}
    occ = {r.symbol: r for r in scip.occurrences(docs).collect()}
    o = occ["py zoo/Dog#sound()."]
    assert (o.start_line, o.start_col, o.end_line, o.end_col, o.is_definition, o.syntax_kind) == (5, 2, 5, 7, True, "identifier_function_definition")
    assert (o.enclosing_start_line, o.enclosing_end_col) == (5, 7)
    o = occ["local 1"]
    assert (o.end_line, o.end_col, o.is_read, o.enclosing_start_line, o.enclosing_end_line, o.syntax_kind) == (9, 4, True, 7, 10, "identifier_local")
    located = {r.scip_symbol: r for r in scip.located(scip.symbols(docs), scip.occurrences(docs)).collect()}
    assert located["local 2"].display_name == "2" and located["local 2"].def_start_line == 3 and located["local 2"].kind == "symbol"
    assert located["Animal#"].def_start_line is None and located["py zoo/Dog#sound()."].def_start_line == 5


GO = b'package main\n\nimport "fmt"\n\ntype Service struct{}\n\nfunc (s Service) Run() { fmt.Println("} // no") }\n\nfunc main() {\n\tvar x = 1\n\tfmt.Println(x)\n}\n'
JAVA = b'package a.b;\n\nimport java.util.List;\n\npublic class Greeter {\n    private final String name = "{";\n\n    public Greeter(String name) {\n        this.name = name;\n    }\n\n    public String greet() {\n        return "Hello " + name;\n    }\n}\n'
RUST = b"use std::fmt::Debug;\n\npub struct Worker;\n\nimpl Worker {\n    pub fn run(&self) {}\n}\n\npub fn execute() {}\n"
TS = b'import { helper } from "./lib/util"\n\nexport interface Greeter {\n  greet(name: string): string\n}\n\nexport class ConsoleGreeter {\n  greet(name: string): string {\n    return helper(name)\n  }\n}\n\nexport const makeGreeter = (prefix: string) => {\n  return (name: string) => helper(prefix + name)\n}\n'
PYTHON = b"import os\nfrom a import b\n\n@deco\nclass A:\n    def f(self):\n        return os\n\nasync def g(): pass\n"


@pytest.mark.parametrize(
    ("path", "source", "expected"),
    [
        ("main.go", GO, {("module", "main.go"), ("import_declaration", 'import "fmt"'), ("type_declaration", "type Service struct{}"), ("function_declaration", "main"), ("method_declaration", "Run")}),
        ("Greeter.java", JAVA, {("package_declaration", "package a.b;"), ("import_declaration", "import java.util.List;"), ("class_declaration", "Greeter"), ("constructor_declaration", "Greeter"), ("method_declaration", "greet"), ("field_declaration", "name")}),
        ("lib.rs", RUST, {("module", "lib.rs"), ("use_declaration", "use std::fmt::Debug;"), ("struct_item", "Worker"), ("impl_item", "Worker"), ("function_item", "execute"), ("function_item", "run")}),
        ("src/index.ts", TS, {("module", "index.ts"), ("import_statement", 'import { helper } from "./lib/util"'), ("interface_declaration", "Greeter"), ("class_declaration", "ConsoleGreeter"), ("method_definition", "greet"), ("method_signature", "greet"), ("lexical_declaration", "makeGreeter")}),
        ("src/component.tsx", b"export const Button = () => <button>Hello</button>", {("module", "component.tsx"), ("lexical_declaration", "Button")}),
        ("a.py", PYTHON, {("module", "a.py"), ("import_statement", "import os"), ("import_from_statement", "from a import b"), ("class_definition", "A"), ("function_definition", "f"), ("function_definition", "g")}),
    ],
)
def test_chunks(path, source, expected):
    got = chunkers.extract(path, source)
    assert expected <= {(c["kind"], c["name"]) for c in got}
    for c in got:
        assert source[c["start_byte"] : c["end_byte"]].decode() == c["text"] and c["chunk_key"].startswith(path)
    main = [c for c in got if c["name"] in ("main", "execute", "makeGreeter", "g") and c["kind"] != "module"]
    assert all(c["text"].rstrip().endswith(("}", "pass")) for c in main)


def test_chunk_files(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.txt", b"x"), ("bad.py", b"def ("), ("empty.py", b"")], "relative_path string, content binary")
    got = chunkers.chunk_files(files).collect()
    assert {r.file_path for r in got} == {"a.go", "bad.py", "empty.py"} and sum(r.kind == "module" for r in got) == 3


def test_tree_and_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    for name, text in (("a.py", "x = 1\n"), ("sub/b.py", "y\nz"), ("node_modules/c.py", ""), (".gitignore", "ignored.py\n"), ("ignored.py", "q")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = fs.tree(spark, f"file://{tmp_path}")
    rows = {r.relative_path: r for r in tree.where(~F.col("relative_path").startswith(".git/")).collect()}
    assert rows["sub/b.py"].line_count == 2 and rows["node_modules/c.py"].line_count == 0
    assert {r.relative_path for r in fs.source_files(tree, "python").collect()} == {"a.py", "sub/b.py", "node_modules/c.py", "ignored.py"}
    assert not git.is_repository("/")
    run("init", "-q")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "first")
    since = git.head(str(tmp_path))
    (tmp_path / "a.py").rename(tmp_path / "moved.py")
    (tmp_path / "sub/b.py").write_text("y\nz\nw\n")
    (tmp_path / "new.py").write_text("n")
    run("add", "moved.py", "a.py")
    assert git.is_repository(str(tmp_path)) and len(since) == 40
    assert {r.relative_path for r in git.untracked(spark, str(tmp_path)).collect()} == {"new.py"}
    assert "ignored.py" not in {r.relative_path for r in git.listed(spark, str(tmp_path)).collect()}
    assert {r.relative_path for r in git.changed(spark, str(tmp_path), since).collect()} == {"a.py", "moved.py", "sub/b.py"}
    assert {r.path: (r.added, r.deleted) for r in git.diff(spark, str(tmp_path), since).collect()} == {"a.py => moved.py": (0, 0), "sub/b.py": (2, 1)}


def test_stream_keeps_a_store_fresh(spark, tmp_path):
    schema = "relative_path string, text string, version long, deleted boolean"
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("/r", "text", {"files": spark.createDataFrame([("a", "old", 1)], "relative_path string, content_hash string, line_count int")})
    batches = [[("a", "one", 1, False), ("a", "two", 2, False), ("b", "x", 1, False)], [("b", None, 2, True), ("c", "y\nz", 1, False)], [("c", "y\nz", 2, False)]]
    versions = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.follow(stream, store, "/r", "text", f"{tmp_path}/checkpoint").awaitTermination()
        versions.append({r.relative_path: r.content_hash[:4] for r in store.table("files").collect()})
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert versions == [{"a": h("two"), "b": h("x")}, {"a": h("two"), "c": h("y\nz")}, {"a": h("two"), "c": h("y\nz")}]
    before = store.manifest()
    incremental.apply_batch(store, "/r", "text", spark.createDataFrame(batches[2], schema))
    assert store.manifest() == before


def test_embedding_providers(spark):
    texts = spark.createDataFrame([("chunk", "a", "x"), ("chunk", "b", "yy"), ("chunk", "c", "")], "owner_type string, owner_key string, text string")
    assert embedding.NoProvider().embed(texts).count() == 0
    table = spark.createDataFrame([("chunk", "a", [1.0, 2.0])], "owner_type string, owner_key string, vector array<float>")
    assert [r.vector for r in embedding.TableProvider(table).embed(texts).collect()] == [[1.0, 2.0]]

    def load():
        def model(batch):
            if len(batch) > 1:
                raise MemoryError
            return [[float(len(t)), 1.0] for t in batch]

        return model

    got = embedding.ModelProvider(load, batch=8, dimension=2).embed(texts).collect()
    assert {r.owner_key: r.vector for r in got} == {"a": [1.0, 1.0], "b": [2.0, 1.0], "c": [0.0, 1.0]}
    tokens = spark.createDataFrame([([[3.0, 0.0], [1.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    assert tokens.select(embedding.mean_pooled(F.col("t"), F.col("m"))).first()[0] == pytest.approx([2**-0.5, 2**-0.5])
