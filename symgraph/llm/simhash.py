"""SimHash near-dedup: fingerprints that differ in a few bits, found by their segments' bit counts.

A fingerprint's embedding has the number of set bits of each two-bit segment, 32 counts of 0 to 2.
The Manhattan distance of two embeddings is never above the Hamming distance of the fingerprints.
The 32 axes are cut into runs, four more than a number g; embeddings within distance 4 agree on g
runs at least, so the grid has a cell for the counts on each g of them. g follows the number of
different fingerprints, so that cells stay small: with three, for some millions, a fingerprint has 35
cells, with six, for a thousand million, 210. Pairs of a cell are filtered by the Manhattan distance
and then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rekeyed, rows_of, sorted_in, written
from .components import components

MAX_BITS = 4
SHINGLE = 4
#: A cell with more fingerprints than this isn't paired up; see links().
CELL = 48
#: Fingerprints of a cell that a grid is laid out for, on average, were they random.
MEAN_CELL = 4
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: bits that over half of the shingles' XXH64 (seed 42) have."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: ASCII white space and A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 65536):  # a very long text's hashes are never held all at once
        to = min(n, at + 65536)
        pairs = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        fps = [_signed(fingerprint(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th, the text's hash, and fp, the fingerprint as a signed long."""
    rows = rows_of(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def embedding(fp: Column) -> Column:
    """Each segment's count in unary (0, 1 and 2 as 00, 01 and 11), in one long."""
    up = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Of embeddings in unary: the bits in which they differ."""
    return F.bit_count(a.bitwiseXOR(b))


def cell_masks(max_bits: int = MAX_BITS, agree: int = 3) -> list[int]:
    """Masks of the axes of each choice of agree runs among max_bits + agree runs of axes."""
    runs = max_bits + agree
    cuts = [32 * r // runs for r in range(runs + 1)]
    run = [sum(0b11 << 2 * axis for axis in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(run, agree)]


def runs_to_agree(n: int, max_bits: int = MAX_BITS) -> int:
    """The least number of runs, three or more, that gives n random fingerprints cells of MEAN_CELL or fewer: an
    axis has a count of 0, 1 or 2 in a quarter, a half and a quarter of them, which is 1.5 bits."""
    for agree in range(3, 28):
        if n <= MEAN_CELL * 2 ** (1.5 * 32 * agree / (max_bits + agree)):
            return agree
    return 28


def _ball(max_bits: int) -> list[int]:
    """All words of half of max_bits set bits or fewer."""
    return [sum(1 << b for b in c) for k in range(max_bits // 2 + 1) for c in combinations(range(64), k)]


def links(reps: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """reps: fp, distinct, and rep, its id. Returns u, v: links that join what is within max_bits.

    All pairs of a cell of at most `cell` fingerprints are compared. The grid is so fine that random
    fingerprints don't fill a cell; clusters of thousands of near copies do, whatever the grid, and all
    their pairs would be too many. They are linked another exact way, of which the cost is a fixed number
    of rows each: two of them are within max_bits exactly if some word is within half of that from both,
    so each goes to the 2,081 words around it, and those that meet at a word are linked to the first
    there. At a word at most 2,081 different fingerprints can meet. A fingerprint so takes a row a cell
    of the grid, and 2,081 more if it is in such a cluster, at any number of fingerprints.
    """
    embedded = reps.withColumn("e", embedding(F.col("fp")))
    masks = cell_masks(max_bits, runs_to_agree(reps.count(), max_bits))
    keys = [F.xxhash64(F.lit(k), F.col("e").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]
    filed = embedded.select("fp", "rep", F.explode(F.array(*keys)).alias("cell"))
    one = F.struct("fp", "rep")
    cells = written(
        filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("a"), F.max(one).alias("b")).where("n > 1"), "cells"
    )

    def near(pairs: DataFrame) -> DataFrame:
        close = manhattan(embedding(F.col("a.fp")), embedding(F.col("b.fp"))) <= max_bits
        exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
        return pairs.where(close & exact).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    fuller = cells.where("n > 2").select(rekeyed(F.col("cell")).alias("k"), "n")
    members = written(filed.select(rekeyed(F.col("cell")).alias("k"), one.alias("m")).join(sorted_in(fuller), "k"), "members")
    some = members.where(F.col("n") <= cell)
    pairs = some.select("k", F.col("m").alias("a")).join(sorted_in(some.select("k", F.col("m").alias("b"))), "k").where("a.fp < b.fp")
    full = members.where(F.col("n") > cell).select("m.fp", "m.rep").distinct()
    # Around a fingerprint in two steps, so that no row holds all its words.
    around = full.select("rep", "fp", F.explode(F.lit([_signed(x) for x in _ball(max_bits)])).alias("x"))
    around = around.select("rep", F.col("fp").bitwiseXOR(F.col("x")).alias("word"))
    first = F.min("rep").over(Window.partitionBy("word"))
    met = around.select(F.col("rep").alias("u"), first.alias("v")).where("u <> v")
    return near(cells.where("n = 2")).unionByName(near(pairs.select("a", "b"))).unionByName(met)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A row a document: doc_id, th, fp (long), root, the least fp reachable by links, and component_id,
    the least doc_id reachable. Texts of one doc_id are told apart by th; root names their components.

    Texts without words, null ones too, have fingerprint zero and link like any other. Texts of fewer
    words than a shingle are one shingle. Rows that repeat are returned each. A row without
    doc_id carries no links and has the component of its fingerprint; if no other row has that one,
    component_id is null and root the fingerprint.
    Documents of one fingerprint are one node, so copies in any number cost no pairs. No join here
    or in links() and components() is a broadcast, so the driver holds no rows at any size or setting.
    """
    fps = written(fingerprints(docs), "fingerprints")
    ids = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    found = components(links(ids.select("fp", F.col("fp").alias("rep")), max_bits)).select(F.col("u").alias("rep"), "component")
    rooted = ids.join(sorted_in(found), F.col("fp") == F.col("rep"), "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id")).select(rekeyed(F.col("root")).alias("r"), "component_id")
    classes = rooted.withColumn("r", rekeyed(F.col("root"))).join(sorted_in(least), "r").select(rekeyed(F.col("fp")).alias("k"), "root", "component_id")
    out = fps.withColumn("k", rekeyed(F.col("fp"))).join(sorted_in(classes), "k", "left")
    return out.select("doc_id", "th", "fp", F.coalesce("root", "fp").alias("root"), "component_id")


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
