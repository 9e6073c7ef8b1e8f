"""chunk_symbol_links deals its words out once, with the results of its SQL and of the operator on links."""

import duckdb
import pytest
from pyspark.sql import functions as F

from symgraph.operators import derive
from symgraph.plans import queries_model as qm
from symgraph.sources.corpus import Corpus

LONG = "\n".join(f"word{k % 7} the Again, again; word{k % 3} {' x' * (k % 4)} the" for k in range(150))
#: More than 255 words in a line, a definition that repeats on its line, no text, no source, no words.
DOCS = [
    (10, "Alpha beta alpha alpha\nbeta gamma\n\nalpha", "en", "a"),
    (9, LONG, "en", "a"),
    (2, "beta " + "the " * 600 + "alpha", "en", "b"),
    (11, "beta alpha beta", "de", "a"),
    (3, None, "en", "a"),
    (4, "gamma gamma delta\ngamma", "en", None),
    (5, "", "en", "b"),
    (6, "a b c\n.. ..", "en", "b"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("links"))
    rows = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    rows.withColumn("n_chars", F.char_length("text").cast("long")).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(df):
    return sorted((r.symbol, r.role, r.chunk_kind, r.n_chunks, r.first_chunk, round(float(r.weight), 6)) for r in df.collect())


def test_totals_are_those_of_the_sql(spark, folder):
    con = duckdb.connect()
    con.execute("SET lambda_syntax = 'ENABLE_SINGLE_ARROW'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT symbol, role, chunk_kind, n_chunks, first_chunk, round(weight, 6) FROM ({qm.CHUNK_SYMBOL_LINKS})").fetchall()
    assert rows_of(qm.chunk_symbol_links(spark, folder)) == sorted(found)


def test_totals_are_those_of_links(spark, folder):
    corpus = Corpus(spark, folder)
    corpus.documents = corpus.documents.where("source IS NOT NULL")
    links = derive.chunk_symbol_links(corpus.chunks, corpus.occurrences)
    by = links.groupBy("symbol", "role", F.substring_index("chunk_key", ":", -1).alias("chunk_kind"))
    expected = rows_of(by.agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_key").alias("first_chunk"), F.max("weight").alias("weight")))
    assert expected and rows_of(derive.chunk_symbol_totals(corpus)) == expected


def test_rows_that_repeat_are_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(qm.chunk_symbol_links(spark, str(tmp_path))) == rows_of(qm.chunk_symbol_links(spark, folder))


#: Ids of several texts, of one source and of others, where a text without the word is longer; no id.
SHARED = [
    (10, "\n".join(f"omega line{k}" for k in range(12)), "en", "a"),
    (10, "gamma\nalpha\ngamma alpha beta\n\nalpha\nomega\nalpha alpha alpha", "en", "b"),
    (2, "alpha\nbeta the alpha\n", "en", "b"),
    (2, "beta\nalpha", "en", None),
    (11, None, "de", "a"),
    (None, "alpha beta\ngamma alpha newword", "en", "a"),
    (None, "alpha", "en", "c"),
]


@pytest.mark.parametrize("few", [10_000, 0])
def test_documents_of_an_id_have_each_others_chunks(spark, folder, tmp_path, monkeypatch, few):
    monkeypatch.setattr("symgraph.sources.corpus.FEW_IDS", few)
    docs = spark.createDataFrame(SHARED, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    spark.read.parquet(f"{folder}/documents.parquet").unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET lambda_syntax = 'ENABLE_SINGLE_ARROW'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT symbol, role, chunk_kind, n_chunks, first_chunk, round(weight, 6) FROM ({qm.CHUNK_SYMBOL_LINKS})").fetchall()
    assert rows_of(qm.chunk_symbol_links(spark, str(tmp_path))) == sorted(found)


def test_words_are_dealt_out_once_and_links_never(spark, folder):
    df = qm.chunk_symbol_links(spark, folder)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
