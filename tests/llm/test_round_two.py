"""Operators whose plans were laid out anew, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F
from rows import DOCS, spoilt

from symgraph.llm import exact_dedup, mixing, quality_rules, simhash
from symgraph.llm.common import discard, written

DIR = "/root/testdata/sf0.001"


def by_documents(rows, limit=5, left=0.3):
    """quality_rules.quality_rules() of (doc_id, text, host): kept, words_left, and the text that is left."""
    key = lambda line: line.strip(brute.STRIP).lower()
    lines, hosts = defaultdict(set), defaultdict(set)
    for doc_id, text, host in rows:
        who = doc_id if doc_id is not None else ("text", text or "")
        hosts[host].add(who)
        for line in (text or "").split("\n"):
            if brute.words(line):
                lines[host, key(line)].add(who)
    out = []
    for doc_id, text, host in rows:
        stats = brute.base_stats(text)
        over = lambda line: bool(brute.words(line)) and len(lines[host, key(line)]) > max(limit, math.log2(len(hosts[host])))  # noqa: B023, E731
        kept = [x for x in (text or "").split("\n") if not over(x)]
        n = sum(len(brute.words(x)) for x in kept)
        out.append((doc_id, not stats[-1] and n >= 20 and n >= left * stats[0], n, "\n".join(kept)))
    return out


def boilerplate_rows():
    """One host of 200 documents and a small one, with lines in so many of their documents, and copies."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    common = {n: line(10) for n in (5, 6, 7, 8, 9, 50, 150)}
    rows = [(k, "\n".join([*(c for n, c in common.items() if k < n), line(12 + k % 9)]), "big") for k in range(200)]
    rows += [(300 + k, rows[199][1], "big") for k in range(12)]  # copies, a document each
    return rows + [(400 + k, "\n".join([common[5], line(25)]), "small") for k in range(6)]


def test_boilerplate_is_counted_by_documents(spark, awkward):
    own = spark.createDataFrame(spoilt([(i, t, "en", h, 1) for i, t, h in boilerplate_rows()]), DOCS)
    for df in (own, awkward, spark.read.parquet(f"{DIR}/documents.parquet")):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        expected = by_documents(rows)
        got = quality_rules.query(df, copies_count_once=False)
        assert Counter((r.doc_id, r.kept, r.words_left) for r in got.collect()) == Counter(r[:3] for r in expected)
        texts = quality_rules.cleaned(df).select("doc_id", "text").collect()
        assert Counter(map(tuple, texts)) == Counter((r[0], r[3]) for r in expected)


def test_limits_grow_slowly(spark):
    """Of 212 documents lines of 8 and more are boilerplate, and the copies' own, at any share of the host."""
    own = spark.createDataFrame(spoilt([(i, t, "en", h, 1) for i, t, h in boilerplate_rows()]), DOCS)
    over = quality_rules.boilerplate(own, quality_rules.host_lines(own)).groupBy("host").count().collect()
    assert {r.host: r["count"] for r in over} == {"big": 4 + 1, "small": 1}


def test_grid_follows_the_number_of_fingerprints():
    assert [simhash.runs_to_agree(n) for n in (0, 10**3, 10**6)] == [3, 3, 3]
    cells = lambda n: len(simhash.cell_masks(4, simhash.runs_to_agree(n)))
    assert (cells(10**6), cells(10**9), cells(10**11)) == (35, 210, 1365)
    assert all(mask.bit_count() % 2 == 0 for mask in simhash.cell_masks(4, 9))


@pytest.mark.parametrize("agree", [3, 5, 6])
def test_near_fingerprints_share_a_cell_of_any_grid(agree):
    rng = random.Random(agree)

    def unary(x):
        return ((x | x >> 1) & simhash._LOW) | (x & x >> 1 & simhash._LOW) << 1

    for _ in range(300):
        fp = rng.getrandbits(64)
        other = fp ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(unary(fp) & m == unary(other) & m for m in simhash.cell_masks(4, agree))


@pytest.mark.parametrize("span", [2, 7, 256])
def test_large_groups_are_compared_in_streams(spark, awkward, span):
    rows = [(k, f"Text {k % 3}", "en", "s", 1) for k in range(60)] + [(5, "Text 2", "en", "s", 1), (None, "text 0", "en", "s", 1), (None, "null", "en", "s", 1), (None, "NULL", "en", "s", 1)]
    for df in (spark.createDataFrame(spoilt(rows), DOCS), awkward):
        plain = [tuple(r) for r in df.select("doc_id", "text").collect()]
        keep = {}
        for i, t in plain:
            t = (t or "").translate(brute.LOWER)
            keep[t] = max((x for x in (keep.get(t), i) if x is not None), default=None)
        size = Counter((t or "").translate(brute.LOWER) for _, t in plain)
        expected = Counter((i, keep[x := (t or "").translate(brute.LOWER)], size[x]) for i, t in plain)
        got = exact_dedup.exact_duplicates(df, span=span).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expected
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(size) and all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("span", [2, 256])
def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch, span):
    """Were all fingerprints alike, the comparison alone would still group right."""
    docs = spark.createDataFrame([(k, f"text {'abc'[k % 3]}") for k in range(20)], "doc_id long, text string")
    plain = exact_dedup.fingerprinted
    alike = lambda *a: plain(*a).withColumns({f"f{k}": F.lit(7).cast("long") for k in range(1, 5)})
    monkeypatch.setattr(exact_dedup, "fingerprinted", alike)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, span=span).collect()}
    last = {0: 18, 1: 19, 2: 17}
    assert got == {k: (last[k % 3], 7 if k % 3 < 2 else 6, k == last[k % 3]) for k in range(20)}


def test_slots_draw_their_sources(spark):
    rows = [(k, "w " * (40 + k % 50), "en", f"s{k % 4}", 1) for k in range(400)]
    _, sources, _ = mixing.taken(spark.createDataFrame(spoilt(rows), DOCS))
    _, sources = mixing.place(spark.createDataFrame(spoilt(rows), DOCS), block=16)
    plan = {r.sid: r for r in sources.collect()}
    got = mixing.drawn(sources, shard=32).collect()
    total = sum(r.slots for r in plan.values())
    assert sorted(r.place for r in got) == list(range(total))
    of = defaultdict(list)
    for r in got:
        of[r.sid].append(r.k)
    assert {s: sorted(ks) for s, ks in of.items()} == {s: list(range(r.slots)) for s, r in plan.items() if r.slots}
    # A shard's counts scatter as draws do: about as far from their mean as the root of it.
    counts = Counter((r.place // 32, r.sid) for r in got)
    whole = total // 32 * 3 // 4  # the last shards settle the totals
    for s, r in plan.items():
        p = r.slots / total
        spread = sum((counts[k, s] - 32 * p) ** 2 for k in range(whole)) / whole
        assert 0.5 < spread / (32 * p * (1 - p)) < 1.7


@pytest.mark.parametrize("n", [1, 2, 7, 256])
def test_permutations_are_undone(spark, n):
    x = mixing.permuted(F.col("id"), F.lit(n), F.lit(3))
    got = spark.range(n).select("id", mixing.permuted(x, F.lit(n), F.lit(3), inverse=True).alias("back")).collect()
    assert all(r.id == r.back for r in got)


def test_sums_of_what_is_before(spark):
    rng = random.Random(4)
    rows = [(s, k, rng.randint(0, 9)) for s in range(3) for k in range(200) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "s int, at long, n long")
    got = mixing.ahead_of(df, ["s"], "at", "n", F.lit(200.0)).collect()
    assert {(r.s, r["at"]): r.ahead for r in got} == {(s, k): sum(n for t, j, n in rows if t == s and j < k) for s, k, _ in rows}
    whole = df.groupBy("at").agg(F.sum("n").alias("n"))
    of = {r["at"]: r.n for r in whole.collect()}
    assert {r["at"]: r.ahead for r in mixing.ahead_of(whole, [], "at", "n", F.lit(200.0)).collect()} == {k: sum(n for j, n in of.items() if j < k) for k in of}


def test_what_was_written_can_be_discarded(spark):
    one, two = (written(spark.range(3), n) for n in ("one", "two"))
    discard(one)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        one.count()
    assert two.count() == 3
