"""Packing and mixing against plain Python."""

import zlib
from collections import defaultdict

import brute
import pytest
from rows import DOCS, spoilt

from symgraph.llm import mixing, packing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def whole_ids():
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_packing(awkward, sample):
    ids = whole_ids()
    for df in (awkward, sample):
        rows = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
        ids_of = {r.doc_id: ids(r.text) for r in rows}
        got = packing.query(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            own = ids_of[r.doc_id]
            assert r.doc_tokens == len(own) // 4 and r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) and r.length > 0
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append((r.start, r.length))
        for parts, total in [(p, len(ids_of[d]) // 4) for d, p in pieces.items()]:
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
            assert end == total
        assert set(pieces) == set(ids_of) and set(sequences) == set(range(len(sequences)))
        for k, parts in sequences.items():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end == packing.LENGTH or (k == len(sequences) - 1 and end < packing.LENGTH)


def test_repeated_rows_are_packed_each(awkward):
    rows = awkward.count()
    got = packing.query(awkward)
    assert got.where("start = 0").count() == rows


def test_word_tokenizer_is_the_tokenizer():
    ids, words = whole_ids(), packing.WordTokenizer(packing.tokenizer_path())
    for text in ("I'll don't 123 é ́x İ ΑΣ Σ\x1c\x85a  b \xa0", "<|endoftext|> a<|startoftext|>b", "日本語 \U0001f600!?", "a" * 5000, ""):
        assert words.encode(text) + (1).to_bytes(4, "little") == ids(text), text


def test_mixing(awkward, sample):
    for df in (awkward, sample):
        rows = df.select("doc_id", "text", "source").collect()
        sizes, by = defaultdict(int), defaultdict(list)
        for r in rows:
            sizes[r.source] += len(brute.words(r.text))
            by[r.doc_id].append((r.source, len(brute.words(r.text))))
        targets = brute.targets(sizes)
        got = mixing.query(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(brute.words(r.text))) for r in rows)
        taken = defaultdict(int)
        for r in got:
            source = next(s for s, n in by[r.doc_id] if n == r.size)
            assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source]) and 0 <= r.taken <= 2 * r.size
            taken[source] += r.taken
        assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())
        again = mixing.query(df.repartition(7)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(awkward):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    got = mixing.mixed_documents(awkward, columns).collect()
    taken = sorted((str(r.doc_id), r.taken) for r in mixing.query(awkward).collect() if r.taken)
    assert taken == sorted((str(r.doc_id), len(brute.words(r.text))) for r in got)
    texts = {r.doc_id: r.text for r in awkward.select("doc_id", "text").collect()}
    for r in got:
        own = brute.words(texts[r.doc_id]) if r.doc_id is not None else None
        assert own is None or set(brute.words(r.text)) <= set(own)
        assert r.n_chars == len(r.text)


def test_slots_are_dealt_to_whole_shards(spark):
    rows = [(k, "w " * (100 + 37 * k % 900), "en", f"s{k % 3}", 1) for k in range(300)]
    placed, sources, _ = mixing.taken(spark.createDataFrame(spoilt(rows), DOCS))
    got = mixing.slots(mixing.pieces(placed), sources, shard=16).collect()
    at = sorted(16 * r.shard + r.slot for r in got)
    assert at == list(range(len(got)))
    shards = defaultdict(set)
    for r in got:
        shards[r.shard].add(r.sid)
    assert sum(len(s) > 1 for s in shards.values()) > len(shards) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutations(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(4)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


@pytest.mark.parametrize("query", [mixing.query, packing.query])
def test_no_rows(no_docs, query):
    assert query(no_docs).count() == 0


def test_no_words(spark):
    got = mixing.query(spark.createDataFrame(spoilt([(1, "", "en", "a", 0), (2, None, "en", None, 0)]), DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
