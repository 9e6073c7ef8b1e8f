"""Scalar functions on the cases that matter."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions import scoring as sx
from symgraph.functions import text as fx


def values(spark, rows, use, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(use(F.col("v"))).collect()]


def test_like_folds_ascii_only_and_keeps_wildcards(spark):
    rows = ["Éa", "éa", "a_b", "axb", "A\\B", "100%"]
    assert values(spark, rows, lambda c: fx.like(c, "É")) == [True, False, False, False, False, False]
    assert values(spark, rows, lambda c: fx.like(c, "a_b")) == [False, False, True, True, True, False]
    assert values(spark, rows, lambda c: fx.like(c, "a_b", literal=True)) == [False, False, True, False, False, False]
    assert values(spark, rows, lambda c: fx.like(c, "a\\b")) == [False, False, False, False, True, False]
    assert values(spark, rows, lambda c: fx.like(c, "AX", prefix=True)) == [False, False, False, True, False, False]
    assert fx.like_escape("a%b_c\\") == "a\\%b\\_c\\\\"


def test_terms(spark):
    assert fx.search_terms("  The (cat), the `CAT` é éé in") == ["the", "cat", "éé"]
    assert fx.query_terms("a. 'b' !!") == ["a", "b"]
    assert values(spark, ["  The (cat), the `CAT` é éé in"], fx.search_terms_column) == [["the", "cat", "éé"]]
    names = ["a.b", "_x", "1a", "a b", "", "a:b/c#d()-"]
    assert values(spark, names, fx.is_identifier_column) == [fx.is_identifier(n) for n in names] == [True, True, False, False, False, True]


@pytest.mark.parametrize(
    ("symbol", "name", "python"),
    [
        ("local 12", "12", "12"), ("scip-go gomod pkg v1 `pkg/sub`/Type#Method().", "Method", "Type#Method"), ("a/b:c#d.", "d", "b:c#d"),
        ("pkg handler()", "pkg handler", "pkg handler"), ("x/y.Foo(int, a.B).", "Foo", "y.Foo"), ("...", "...", "..."), ("  ", "", ""),
    ],
)
def test_display_names(spark, symbol, name, python):
    assert values(spark, [symbol], fx.display_name) == [name]
    assert values(spark, [symbol], lambda c: fx.display_name(c, python=True)) == [python]


def test_texts(spark):
    assert values(spark, ["", "a", "a\n", "a\nb", "\n\n"], fx.line_count) == [0, 1, 1, 2, 2]
    assert values(spark, ["é" * 90], fx.header_text) == ["é" * 80]
    assert values(spark, ["aé"], lambda c: fx.first_bytes(c, 2)) == ["a"]
    assert values(spark, ["func f() {\n x", "  if a; {", "x" * 9], lambda c: fx.code_preview(c, 8)) == ["func f()", "if a;", "x" * 8 + "..."]
    assert values(spark, ["a\nb\nc\nd", "a\nb"], lambda c: fx.truncate_lines(c, 2)) == ["a\nb\n\n... (2 lines left out)", "a\nb"]
    assert values(spark, ["```go\nfunc  f()\n```", "a\n\n b"], fx.flatten_doc) == ["func f()", "a b"]
    assert values(spark, ["```go\n x \n```\n\ny"], fx.strip_code_fences) == ["x y"]
    assert values(spark, ["func_declaration", "function_item", "", "impl_item", "method_definition"], fx.kind_label) == ["Function", "Function", "Result", "Implementation", "Method"]
    assert values(spark, ["IdentifierFunction", "UnspecifiedKind", "AbstractMethod"], lambda c: fx.enum_label(c, suffix="Kind")) == ["identifier_function", "", "abstract_method"]
    assert values(spark, ["/r/a/b", "/x/b", "a/b", "../c"], lambda c: fx.display_path(c, "/r")) == ["./a/b", "/x/b", "./a/b", "../c"]
    assert values(spark, ["python-scip", "--", " A b "], fx.artifact_suffix) == ["python_scip", "workspace", "a_b"]
    assert values(spark, [" a b ", ".", ""], lambda c: fx.unit_name(c, "project")) == ["a-b", "project", "project"]


def test_renames_and_paths(spark):
    rows = ["a/{x => y}/b.go", "old.go => new.go", "a/{ => y}/b.go", "plain.go", "a/{x => x}/c"]
    assert values(spark, rows, fx.renamed_paths) == [["a/x/b.go", "a/y/b.go"], ["old.go", "new.go"], ["a//b.go", "a/y/b.go"], ["plain.go"], ["a/x/c"]]
    rows = ["a\\b", "./a//b", "a/../b", "../a", "a/b/../../c", "/etc"]
    assert values(spark, rows, fx.clean_path) == ["a/b", "a/b", "b", "../a", "c", "/etc"]
    assert values(spark, rows, lambda c: fx.inside_root(fx.clean_path(c))) == [True, True, True, False, True, False]


def test_scores(spark):
    assert values(spark, [0.0, 1.0, -1.0], sx.similarity, "v double") == [1.0, 0.5, 1.0]
    soft = values(spark, [10.0, 9.0, 2.0], lambda c: sx.softmax(c, 4.0), "v double")
    assert sum(soft) == pytest.approx(1) and sorted(soft, reverse=True) == sorted(soft)[::-1] and len(set(soft)) == 3
    assert 0.8 < max(values(spark, [3.0, 1.0, 0.2], sx.softmax, "v double")) < 0.9
    ratio = spark.createDataFrame([(0, 5), (3, 0), (2, 4), (9, 4)], "c int, t int").select(sx.changed_ratio(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in ratio] == [0.0, 1.0, 0.5, 1.0]
    ranges = values(spark, [[1, 2, 3], [1, 2, 3, 4]], sx.decoded_range, "v array<int>")
    assert [tuple(r) for r in ranges] == [(1, 2, 1, 3), (1, 2, 3, 4)]
    with pytest.raises(Exception, match="3 or 4"):
        values(spark, [[1, 2]], sx.decoded_range, "v array<int>")
    kinds = spark.createDataFrame([("module", 0, 9), ("import_statement", 0, 0), ("class_definition", 0, 0), ("block", 0, 79)], "k string, s int, e int")
    got = [r[0] for r in kinds.select(sx.reranked(F.lit(1.0), F.col("k"), F.col("s"), F.col("e"))).collect()]
    assert got == pytest.approx([0.3, 0.45, 1.15, 0.5])
