"""Quality rules, line dedup, SimHash, exact dedup against plain Python."""

from collections import Counter

import brute
import pytest
from rows import DOCS, spoilt
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import components, exact_dedup, line_dedup, quality_rules, simhash

DIR = "/root/testdata/sf0.001"


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_base_stats(awkward, sample):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (awkward, sample):
        expected = Counter((r.doc_id, *brute.base_stats(r.text)) for r in df.select("doc_id", "text").collect())
        assert bag(quality_rules.query(df), *columns) == expected


def test_quality_rules(awkward, sample):
    for df in (awkward, sample):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        expected = Counter((r[0], r[7], r[8]) for r in brute.quality_rules(rows))
        assert bag(quality_rules.query(df), "doc_id", "kept", "words_left") == expected


def test_quality_rules_boilerplate(spark):
    common = "this line stands everywhere on the host with many words in it indeed and then some more of them to be sure"
    rows = [(k, f"{common}\nown words {k}", "en", "h", 1) for k in range(30)] + [(k, f"{common} {k}", "en", "g", 1) for k in range(30, 60)]
    got = quality_rules.query(spark.createDataFrame(spoilt(rows), DOCS)).collect()
    assert {r.doc_id: r.kept for r in got} == {k: k >= 30 for k in range(60)}


def test_line_dedup(awkward, sample):
    for df in (awkward, sample):
        rows = [tuple(r) for r in df.select("doc_id", "text").where("doc_id IS NOT NULL").collect()]
        got = line_dedup.query(df.where("doc_id IS NOT NULL"))
        assert bag(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter(brute.line_dedup(rows))
    assert line_dedup.query(awkward).count() == awkward.count()


def test_simhash(awkward, sample):
    for df in (awkward, sample):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = simhash.query(df).collect()
        fp = {r[0]: brute.fingerprint(r[1]) for r in rows if r[0] is not None}
        ids = sorted(fp)
        component = brute.components(ids, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{brute.fingerprint(t):016x}") for d, t in rows)
        assert all(r.component_id == component[r.doc_id] for r in got if r.doc_id is not None)
        by_fp = {f: component[i] for i, f in fp.items()}
        assert all(r.component_id == by_fp.get(int(r.fingerprint, 16)) for r in got if r.doc_id is None)


@pytest.mark.parametrize("cell", [2, 6, 1000])
def test_links_in_crowded_cells(spark, cell):
    """All three ways to link a cell give the same components, for clouds of fingerprints and strays."""
    import random

    rng = random.Random(cell)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, 1, (1 << 64) - 1, 1 << 63}
    for centre in (rng.getrandbits(64), 0x5555AAAA5555AAAA):
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
    fps = sorted(fps)
    rng.shuffle(fps)
    reps = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    found = components.components(simhash.links(reps, cell=cell)).collect()
    component = {k: k for k in range(len(fps))} | {r.u: r.component for r in found}
    assert component == brute.components(range(len(fps)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
@settings(max_examples=200, deadline=None)
def test_near_fingerprints_share_a_cell(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b

    def unary(x):
        either, both = (x | x >> 1) & simhash._LOW, x & x >> 1 & simhash._LOW
        return either | both << 1

    a, b = unary(fp), unary(other)
    assert (a ^ b).bit_count() <= (fp ^ other).bit_count()
    assert any(a & m == b & m for m in simhash.cell_masks())


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 150), (7, 7)] + [(300, k) for k in range(301, 340)]
    got = {r.u: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 150: 100} | {k: 300 for k in range(301, 340)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_dedup(awkward, sample):
    for df in (awkward, sample):
        for how in ({}, {"huge": 500, "part": 128}):
            rows = [tuple(r) for r in df.where("doc_id IS NOT NULL").select("doc_id", "text").collect()]
            got = exact_dedup.exact_duplicates(df.where("doc_id IS NOT NULL"), **how)
            assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == Counter(brute.exact_groups(rows))
            kept = [r for r in got.collect() if r.kept]
            assert len(kept) == len({r.text_sha256 for r in got.collect()}) and all(r.doc_id == r.keep_id for r in kept)
    nulls = exact_dedup.query(awkward).where("doc_id IS NULL").collect()
    assert sorted((r.keep_id is None, r.kept) for r in nulls) == [(False, False), (True, True)]


@given(st.binary(max_size=400), st.integers(0, 400))
@settings(max_examples=100, deadline=None)
def test_fingerprints_combine(data, cut):
    a, b = data[:cut], data[cut:]
    whole = exact_dedup.fingerprint(data)
    assert exact_dedup.combined(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == whole
    plain = tuple(sum((c + 1) * pow(x, len(data) - 1 - k, p) for k, c in enumerate(data)) % p for x, p in zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True))
    assert whole == plain


def test_equal_fingerprints_of_different_texts_stay_apart():
    """With all fingerprints alike the comparison alone tells texts apart."""
    import pyarrow as pa

    rows = [(1, b"a"), (2, b"a"), (2, b"a"), (3, b"b"), (4, b"a")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])] + [pa.array(["s"] * 5)] + [pa.array([0] * 5)] * 4,
        ["doc_id", "norm", "sha", "f1", "f2", "f3", "f4"],
    )
    (out,) = exact_dedup._compared(iter([batch]))
    assert out.column("cls").to_pylist() == [0, 0, 0, 1, 0] and out.column("again").to_pylist() == [False, False, True, False, False]
    assert exact_dedup.same_bytes(b"x" * 200_000, b"x" * 200_000) and not exact_dedup.same_bytes(b"x" * 200_000, b"x" * 199_999 + b"y")


@pytest.mark.parametrize("query", [quality_rules.query, line_dedup.query, simhash.query, exact_dedup.query])
def test_no_rows(no_docs, query):
    assert query(no_docs).count() == 0
