"""Exact dedup: polynomial fingerprints that combine, and texts compared chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rekeyed, rows_of, written

#: Four primes below 2^31 and a base for each; 124 bits together.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 69069, 214013)
#: Bytes of a chunk: small enough for sums of products in 64 bits.
CHUNK = 1 << 16
#: Texts of more bytes are cut into parts, which go to as many tasks.
HUGE = 1 << 23
PART = 1 << 22
#: Rows of a group that are compared in one stream; larger groups take several.
SPAN = 256
#: What texts may be equal by: the fingerprint and the length.
PRINT = ("f1", "f2", "f3", "f4", "size")


@cache
def _powers() -> list:
    """For each modulus, the base's powers from CHUNK - 1 down to 0."""
    import numpy as np

    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        row = [1]
        for _ in range(CHUNK - 1):
            row.append(row[-1] * b % p)
        out.append(np.array(row[::-1], np.uint64))
    return out


def chunk_hash(chunk: bytes) -> tuple[int, ...]:
    """The polynomial in the base with the bytes (plus one) as coefficients, for each modulus."""
    import numpy as np

    a = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(a, w[CHUNK - len(a) :])) % p for w, p in zip(_powers(), PRIMES, strict=True))


def shifted(h: tuple[int, ...], length: int) -> tuple[int, ...]:
    """h of a text that has `length` bytes to follow."""
    return tuple(x * pow(b, length, p) % p for x, b, p in zip(h, BASES, PRIMES, strict=True))


def combined(a: tuple[int, ...], b: tuple[int, ...], b_length: int) -> tuple[int, ...]:
    """The fingerprint of two texts one after the other."""
    return tuple((x + y) % p for x, y, p in zip(shifted(a, b_length), b, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, ...]:
    h = (0,) * len(PRIMES)
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        h = combined(h, chunk_hash(chunk), len(chunk))
    return h


def _prints(batches: Iterator) -> Iterator:
    """doc_id, th, text -> doc_id, th, size, sha, f1..f4."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        norm = [t.encode().lower() for t in b.column("text").to_pylist()]  # of bytes: A-Z only
        prints = [fingerprint(t) for t in norm]
        columns = [b.column("doc_id"), b.column("th"), pa.array([len(t) for t in norm], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in norm])]
        columns += [pa.array([f[k] for f in prints], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "size", "sha", "f1", "f2", "f3", "f4"])


def _part_rows(batches: Iterator) -> Iterator:
    """doc_id, th, at, part, after (bytes that follow) -> doc_id, th, at, f1..f4 shifted."""
    import pyarrow as pa

    for b in batches:
        parts, after = b.column("part").to_pylist(), b.column("after").to_pylist()
        prints = [shifted(fingerprint(t), n) for t, n in zip(parts, after, strict=True)]
        columns = [b.column(c) for c in ("doc_id", "th", "at")] + [pa.array([f[k] for f in prints], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "at", "f1", "f2", "f3", "f4"])


PRINTED = "doc_id long, th long, size long, sha string, f1 long, f2 long, f3 long, f4 long"


def _rows(docs: DataFrame) -> DataFrame:
    return rows_of(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def fingerprinted(docs: DataFrame, huge: int = HUGE, part: int = PART) -> DataFrame:
    """doc_id, th, and of the lower-cased text its size in bytes, sha (SHA-256) and f1 to f4 (its fingerprint).

    A huge text's parts are hashed in tasks of their own; shifted by the bytes that follow, their
    hashes only need adding up.
    """
    rows = _rows(docs)
    usual = rows.where(F.octet_length("text") <= huge).select("doc_id", "th", "text").mapInArrow(_prints, PRINTED)
    large = rows.where(F.octet_length("text") > huge).select("doc_id", "th", ascii_lower(F.col("text")).cast("binary").alias("norm"))
    size = F.octet_length("norm")
    starts = F.explode(F.sequence(F.lit(0), ((size - 1) / part).cast("int")))
    parts = large.select("doc_id", "th", "norm", size.alias("size"), starts.alias("at"))
    cut = F.substring(F.col("norm"), F.col("at") * part + 1, F.lit(part))
    parts = parts.select("doc_id", "th", "at", cut.alias("part"), F.greatest(F.col("size") - (F.col("at") + 1) * part, F.lit(0)).cast("long").alias("after"))
    hashed = parts.repartition("doc_id", "th", "at").mapInArrow(_part_rows, "doc_id long, th long, at int, f1 long, f2 long, f3 long, f4 long")
    once = hashed.dropDuplicates(["doc_id", "th", "at"])  # rows that repeat have the same parts
    sums = once.groupBy(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th")).agg(
        *((F.sum(f"f{k + 1}") % F.lit(p)).alias(f"f{k + 1}") for k, p in enumerate(PRIMES))
    )
    whole = large.select("doc_id", "th", size.cast("long").alias("size"), F.sha2("norm", 256).alias("sha"))
    whole = whole.join(sums, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")))
    return usual.unionByName(whole.drop("p_id", "p_th"))


def same_bytes(a: bytes, b: bytes, chunk: int = CHUNK) -> bool:
    """Compares chunk by chunk, up to the first that differs."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[k : k + chunk] == y[k : k + chunk] for k in range(0, len(a), chunk))


def _compared(batches: Iterator) -> Iterator:
    """Rows in order of their key and doc_id: numbers the different texts of a key, and marks rows that repeat the
    doc_id before. Holds one text of each such number, and one batch."""
    import pyarrow as pa

    key, texts, last = None, [], None
    for b in batches:
        cls, again = [], []
        names = [n for n in b.schema.names if n not in ("doc_id", "th", "sha", "norm", "copy")]
        keys = zip(*(b.column(c).to_pylist() for c in names), strict=True)
        copies = b.column("copy").to_pylist() if "copy" in b.schema.names else [False] * len(b)
        for now, doc_id, text, copy in zip(keys, b.column("doc_id").to_pylist(), b.column("norm").to_pylist(), copies, strict=True):
            if now != key:
                key, texts, last = now, [], None
            at = next((k for k, t in enumerate(texts) if same_bytes(t, text)), len(texts))
            if at == len(texts):
                texts.append(text)
            cls.append(at)
            again.append(last == (doc_id, at))
            last = None if copy else (doc_id, at)
        kept = [n for n in b.schema.names if n != "norm"]
        columns = [b.column(c) for c in kept] + [pa.array(cls, pa.int32()), pa.array(again, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "cls", "again"])


def compared(docs: DataFrame, members: DataFrame, span: int = SPAN) -> DataFrame:
    """members: doc_id, th, PRINT, sha, n (rows of the print) and leader (a doc_id of it), each once. Each row of
    docs that is one of them, with cls, the number of its text among those of its print, and again.

    The rows of a print are compared in streams of about span rows. Where there are several, each begins with a
    copy of the leader's text, so that 0 is the leader's text in all of them; other numbers then only
    hold within a stream.
    """
    own = members.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), *PRINT, "sha", "n", "leader")
    rows = _rows(docs).withColumn("t_size", F.octet_length("text").cast("long"))
    rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")) & (F.col("t_size") == F.col("size")))
    streams = F.ceil(F.col("n") / span)
    key = [*PRINT, "n", "stream"]
    rows = rows.withColumn("stream", F.pmod(F.xxhash64("doc_id"), streams)).withColumn("norm", ascii_lower(F.col("text")).cast("binary"))
    rows = rows.select(*key, "doc_id", "th", "sha", "leader", "norm", F.lit(False).alias("copy"))
    leaders = rows.where((F.col("n") > span) & F.col("doc_id").eqNullSafe(F.col("leader"))).dropDuplicates(list(PRINT))
    leaders = leaders.withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), streams - 1))).withColumn("copy", F.lit(True))
    both = rows.unionByName(leaders).drop("leader")
    both = both.repartition(*key).sortWithinPartitions(*key, F.desc("copy"), "doc_id")
    schema = ", ".join(f"{c} long" for c in key) + ", doc_id long, th long, sha string, copy boolean, cls int, again boolean"
    return both.select(*key, "doc_id", "th", "sha", "norm", "copy").mapInArrow(_compared, schema).where("NOT copy").drop("copy", "stream")


def exact_duplicates(docs: DataFrame, huge: int = HUGE, part: int = PART, span: int = SPAN) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after A-Z are lower-cased; null counts as empty. Of equal texts that with the
    largest doc_id is kept; if rows repeat that doc_id, one of them. Null doc_ids come last: one row
    is kept, with a null keep_id, where all doc_ids of a group are null. No rows: no rows.

    Fingerprints alone are grouped. A text whose fingerprint and length no other row has is alone; only the
    others are read again and compared byte by byte, chunk after chunk. Texts that have the fingerprint of
    their group's leader without being equal to it are compared anew, among themselves.
    """
    prints = written(fingerprinted(docs, huge, part), "prints")
    groups = prints.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("leader"))
    groups = groups.withColumn("k", rekeyed(F.col("f1"))).drop("f1")
    grouped = written(prints.withColumn("k", rekeyed(F.col("f1"))).join(groups, ["k", *PRINT[1:]]).drop("k"), "grouped")
    todo, nr, done = grouped.where("n > 1").select("doc_id", "th", *PRINT, "sha", "n", "leader").distinct(), 0, []
    while True:
        # Written, so that its size is known: while it is small, only its own texts are shuffled.
        found = written(compared(docs, written(todo, "members"), span).withColumn("nr", F.lit(nr)), "compared")
        done.append(found.where((F.col("n") <= span) | (F.col("cls") == 0)))
        rest = found.where((F.col("n") > span) & (F.col("cls") > 0))
        if rest.isEmpty():
            break
        again = rest.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("leader"))
        todo, nr = rest.select("doc_id", "th", *PRINT, "sha").distinct().join(again, list(PRINT)), nr + 1
    found = reduce(DataFrame.unionByName, done)
    key = [*PRINT, "n", "nr", "cls"]
    whole = found.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    whole = whole.withColumn("k", rekeyed(F.col("f1"))).drop("f1")
    found = found.withColumn("k", rekeyed(F.col("f1"))).join(whole, ["k", *key[1:]])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")
    found = found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    alone = grouped.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(found)


def query(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)
