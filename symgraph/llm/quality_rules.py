"""Quality rules: statistics of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, WORD, hash_pair, let, rekeyed, rows_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate of its host when it stands in more documents than this, and than the base-2 logarithm
#: of the host's documents: 20 of a million.
LINE_DOCS = 5
#: A document is depleted when fewer words than MIN_WORDS or than this share of them are left.
LEFT_SHARE = 0.3


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more, in n log n of the words.

    Windows are compared by 64-bit hashes of their words' hashes. Only where one occurs again are
    they sorted with their places; the places of those with an equal neighbour, in order, each
    cover WINDOW words or as many as there are up to the next one.
    """

    def places(s: Column) -> Column:
        n = F.size(s)
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        found = F.transform(s, lambda e, i: F.when(((i > 0) & same(e, i - 1)) | ((i < n - 1) & same(e, i + 1)), e["i"]))
        return F.sort_array(F.array_compact(found))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        )

    def count(g: Column) -> Column:
        s = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(let(s, places), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(let(hashes, windows), count)).cast("long")


def base_stats(docs: DataFrame) -> DataFrame:
    """The statistics of each text, computed within its row: doc_id, th, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col("text")
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), _has_word)
    out = rows_of(docs).select(
        "doc_id",
        "th",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        let(words, _repeat_words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row a line with words: doc_id, th, host, pos, h1 and h2 of the line stripped and lower-cased, its words."""
    rows = rows_of(docs, F.col(host).alias("host"))
    lines = rows.select("doc_id", "th", "host", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h1, h2 = hash_pair(F.lower(F.btrim("line", F.lit(SPACES))))
    return lines.where(_has_word(F.col("line"))).select(
        "doc_id", "th", "host", "pos", h1.alias("h1"), h2.alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words")
    )


def _documents(rows: DataFrame, copies_count_once: bool) -> DataFrame:
    """rows with what tells documents apart: doc_id, or the text where there is none or copies count once."""
    if copies_count_once:
        return rows.withColumns({"by_id": F.lit(None).cast("long"), "by_text": F.col("th")})
    return rows.withColumns({"by_id": F.col("doc_id"), "by_text": F.when(F.col("doc_id").isNull(), F.col("th"))})


def boilerplate(docs: DataFrame, lines: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, copies_count_once: bool = False) -> DataFrame:
    """host, h1, h2 of the lines in more distinct documents of the host than the limit, which grows far slower
    than the host does.

    Both counts first leave one row a document, then count with partial sums: neither a host nor a
    line is a hot task.
    """
    of_hosts = _documents(rows_of(docs, F.col(host).alias("host")), copies_count_once).select("host", "by_id", "by_text")
    sizes = of_hosts.distinct().groupBy(F.col("host").alias("s_host")).agg(F.count(F.lit(1)).alias("host_docs"))
    counts = _documents(lines, copies_count_once).select("host", "h1", "h2", "by_id", "by_text").distinct()
    counts = counts.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > line_docs)
    over = counts.join(sizes, F.col("host").eqNullSafe(F.col("s_host"))).where(F.col("n_docs") > F.log2("host_docs"))
    return over.select("host", "h1", "h2")


def _hits(docs: DataFrame, host: str, line_docs: int, copies_count_once: bool) -> DataFrame:
    """host_lines() with is_common: the line is boilerplate of its host."""
    lines = host_lines(docs, host)
    over = boilerplate(docs, lines, host, line_docs, copies_count_once)
    left = lines.select("doc_id", "th", "pos", "words", "host", rekeyed(F.col("h1")).alias("j1"), rekeyed(F.col("h2")).alias("j2"))
    right = over.select(F.col("host").alias("b_host"), rekeyed(F.col("h1")).alias("b1"), rekeyed(F.col("h2")).alias("b2"))
    hit = left.join(right, (F.col("j1") == F.col("b1")) & (F.col("j2") == F.col("b2")) & F.col("host").eqNullSafe(F.col("b_host")), "left")
    return hit.select("doc_id", "th", "host", "pos", "words", F.col("b1").isNotNull().alias("is_common"))


def cleaned(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, copies_count_once: bool = False) -> DataFrame:
    """A row a document: doc_id, host, text without the host's boilerplate lines, n_removed (lines). Lines without
    a word stay. Null texts are empty ones; rows that repeat are each returned; no rows: no rows."""
    gone = _hits(docs, host, line_docs, copies_count_once).where("is_common")
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), F.col("host").alias("g_host")).agg(F.collect_set("pos").alias("gone"))
    rows = rows_of(docs, F.col(host).alias("host"))
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")) & F.col("host").eqNullSafe(F.col("g_host"))
    kept = F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains("gone", k))
    return rows.join(gone, same, "left").select(
        "doc_id", "host",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE, copies_count_once: bool = False) -> DataFrame:
    """A row a document: doc_id, the statistics of base_stats, words_left and kept.

    words_left are the words outside the host's boilerplate lines. kept is false where base_failed
    or where words_left are fewer than MIN_WORDS or left_share of the words. A line's documents are
    those of distinct doc_ids, a row without one being told apart by its text; with copies_count_once
    those of distinct texts. Null texts are empty ones: no words, failed, not kept. Null hosts are one
    host. Rows that repeat are all returned. Only hashes and counts of lines are dealt out, never
    texts. No rows: no rows.
    """
    # Rows that repeat a document repeat its lines: the share of words is theirs all the same.
    shares = _hits(docs, host, line_docs, copies_count_once).groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.sum("words").alias("all_words"), F.sum(F.when(F.col("is_common"), F.col("words"))).alias("common_words")
    )
    shares = shares.where(F.col("common_words") > 0)
    both = base_stats(docs).join(shares, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
    common = F.coalesce(F.col("common_words") * F.col("n_words") / F.col("all_words"), F.lit(0))
    both = both.withColumn("words_left", F.col("n_words") - F.round(common).cast("long"))
    depleted = (F.col("words_left") < MIN_WORDS) | (F.col("words_left") < left_share * F.col("n_words"))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), "words_left",
    )


def query(docs: DataFrame, copies_count_once: bool = True) -> DataFrame:
    return quality_rules(docs, copies_count_once=copies_count_once)
