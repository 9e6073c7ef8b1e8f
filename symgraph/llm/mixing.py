"""Mixing sources to target weights, in blocks of a fixed number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, rows_of, written

#: Weights of the sources in code point order, repeating; the mix's share of all words; how often a source may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block, blocks of an output shard, rounds of a permutation.
BLOCK = 1024
SHARD = 256
ROUNDS = 24
SEED = 20240607


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """x's image under a pseudorandom permutation of 0 to n - 1, one for each key, or what has x for its image.

    A swap-or-not shuffle: each round pairs x with k - x modulo n, and a hash of the larger of the
    two says whether they change places. It is a bijection for any n, without tables or retries; a
    round undoes itself, so that the rounds from the last to the first are the inverse.
    """

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def ahead_of(counts: DataFrame, key: list[str], at: str, n: str, of: Column) -> DataFrame:
    """counts: key, at (0 and up, once a key) and n. Adds `ahead`, the sum of n of the key's smaller at.

    In two passes, over the stretches of a key's numbers and within each stretch. There are about as many
    stretches of a key as rows in each: the root of `of`, how many numbers it may have.
    """
    width = F.greatest(F.ceil(F.sqrt(of)), F.lit(1))
    rows = counts.withColumn("stretch", F.floor(F.col(at) / width))
    totals = rows.groupBy(*key, "stretch").agg(F.sum(n).alias("total"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "stretch", F.coalesce(F.sum("total").over(before(key, "stretch")), F.lit(0)).alias("outer"))
    inner = F.coalesce(F.sum(n).over(before([*key, "stretch"], at)), F.lit(0))
    return rows.withColumn("inner", inner).join(totals, [*key, "stretch"]).withColumn("ahead", F.col("inner") + F.col("outer")).drop("inner", "outer", "stretch")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds sid (rank by code point, null last), weight and target.

    The targets share the mix by weight and stop at most times their source's size. In order of
    that stop over the weight, a source is stopped if it would be at the level of those before it
    being stopped. One row a source is all that is brought together here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.lit(list(WEIGHTS))
    out = sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
    out = out.withColumn("weight", F.get(weights, F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))).cast("int")).cast("double"))
    out = out.withColumn("stop", (most * F.col("source_size")).cast("double"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    out = out.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    out = out.withColumn("level", (F.col("total") - past("stop")) / (F.col("weights") - past("weight")))
    out = out.withColumn("stopped", F.col("level") > F.col("stop") / F.col("weight"))
    rest = lambda c: F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(whole), F.lit(0.0))
    level = (F.col("total") - rest("stop")) / (F.col("weights") - rest("weight"))
    target = F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("weight") * level)
    return out.select("source", "source_size", "sid", "weight", target.alias("target"))


def plan_sources(sizes: DataFrame, block: int = BLOCK, share: float = SHARE, most: int = MOST) -> DataFrame:
    """targets() with what a source's slots follow from: quota (words), blocks, short (words of the
    last block), at (that block's index in the permutation), slots, base (slots of sources before)."""
    out = targets(sizes, share, most).withColumn("quota", F.round("target").cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    out = out.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
    n = F.greatest(F.col("blocks"), F.lit(1))
    out = out.withColumn("at", permuted(n - 1, n, F.col("sid")))
    rest = F.pmod(F.col("quota"), F.greatest(F.col("source_size"), F.lit(1)))
    full = F.floor(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1)))
    plain = F.ceil(rest / block)
    extra = F.when(plain <= F.col("at"), plain).otherwise(F.ceil((rest + block - F.col("short")) / block))
    out = out.withColumn("slots", F.when(F.col("quota") > 0, full * F.col("blocks") + extra).otherwise(0).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))


def place(docs: DataFrame, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, th, sid, size, start: words of the source before it) and plan_sources().

    start is a prefix sum in two passes: over a source's buckets of hashed documents, and over the documents
    of a bucket. A source has as many buckets as the root of its documents, so no window holds a source.
    """
    rows = rows_of(docs, F.col("source").cast("string").alias("source"))
    rows = written(rows.select("doc_id", "th", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size")), "sizes")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")), "source_sizes")
    sources = written(plan_sources(sizes.drop("source_docs"), block, share, most), "sources")
    root = F.ceil(F.sqrt("source_docs")).cast("long")
    named = sources.join(sizes.select(F.col("source").alias("d_source"), root.alias("buckets")), F.col("source").eqNullSafe(F.col("d_source")))
    named = named.select(F.col("source").alias("s_source"), "sid", "buckets")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.col("buckets"))).drop("buckets")
    totals = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["sid", "bucket"])
    rows = rows.select("doc_id", "th", "sid", "size", (F.col("start") + F.col("ahead")).alias("start"))
    return written(rows, "placed"), sources


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a document and block it has words in: sid, start, block, first (in the block), words."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    out = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return out.withColumn("first", first).withColumn("words", end - F.col("first"))


def drawn(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row a slot of the mix: place (0 and up), sid, and k, the number of the slot among its source's.

    Each slot draws its source by the sources' shares of the slots, so a shard's counts by source are a
    multinomial draw, and slots are numbered by the counts of the shards before. By chance some sources are
    drawn too often: their last slots go, in order, to the sources that were drawn too seldom, so that
    the last shards settle the totals. The draws hang on the slots' places alone.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("all_slots")).first()[0] or 0
    shards = -(-total // shard)
    # A draw is a number below the total; a source has those from its base on. Both meet in equal strips.
    width = max(1, -(-total // 4096))
    lots = sources.where("slots > 0").select("sid", "slots", "base")
    strips = F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("slots") - 1) / width)))
    strips = lots.select(F.col("sid"), "base", (F.col("base") + F.col("slots")).alias("end"), strips.alias("strip"))
    places = spark.range(shards).select(F.explode(F.sequence(F.col("id") * shard, F.least((F.col("id") + 1) * shard, F.lit(total)) - 1)).alias("place"))
    places = places.withColumn("draw", F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("place")), F.lit(max(1, total)))).withColumn("strip", F.floor(F.col("draw") / width))
    got = places.join(strips, "strip").where("draw >= base AND draw < end").select("place", F.floor(F.col("place") / shard).alias("shard"), "sid")
    got = written(got, "draws")
    counts = got.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = ahead_of(counts, ["sid"], "shard", "n", F.lit(float(max(1, shards)))).select("sid", "shard", "ahead")
    own = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("place")) - 1
    numbered = got.withColumn("own", own).join(counts, ["sid", "shard"]).select("place", "sid", (F.col("own") + F.col("ahead")).alias("k"))
    numbered = written(numbered.join(lots.select("sid", "slots"), "sid"), "numbered")
    kept = numbered.where("k < slots").select("place", "sid", "k")
    # The slots drawn too often, numbered in order, meet the numbers that sources lack: about the root of all slots.
    spare = numbered.where("k >= slots").select("place", F.floor(F.col("place") / shard).alias("shard"))
    ahead = ahead_of(spare.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), [], "shard", "n", F.lit(float(max(1, shards)))).select("shard", "ahead")
    of_shard = F.row_number().over(Window.partitionBy("shard").orderBy("place")) - 1
    spare = spare.withColumn("own", of_shard).join(ahead, "shard").select("place", (F.col("own") + F.col("ahead")).alias("nr"))
    had = numbered.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    lack = lots.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    lack = lack.withColumn("first", F.coalesce(F.sum(F.col("slots") - F.col("had")).over(before), F.lit(0)))
    wanted = lack.select("sid", "first", "had", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("k"))
    wanted = wanted.select("sid", "k", (F.col("first") + F.col("k") - F.col("had")).alias("nr"))
    return kept.unionByName(spare.join(wanted, "nr").select("place", "sid", "k"))


def slots(cut: DataFrame, sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """A row a slot of the mix: sid, block, copy, take (words of the block), shard, slot.

    A source's slots run through its blocks in the order of its permutation, again and again, until its
    quota of words is full; the last one takes part of a block. The slot's index under the permutation
    is joined with the blocks that cut has.
    """
    plan = sources.drop("source", "weight", "target", "slots", "base", "all_slots").withColumnRenamed("sid", "p_sid")
    out = drawn(sources, shard).join(plan, F.col("sid") == F.col("p_sid"))
    out = out.withColumn("copy", F.floor(F.col("k") / F.col("blocks")).cast("int")).withColumn("index", F.pmod("k", F.col("blocks")))
    out = out.withColumn("block", permuted(F.col("index"), F.col("blocks"), F.col("sid"), inverse=True))
    ahead = F.col("index") * block - F.when(F.col("index") > F.col("at"), block - F.col("short")).otherwise(0)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(block)
    room = F.col("quota") - F.col("copy") * F.col("source_size") - ahead
    out = out.withColumn("take", F.greatest(F.least(room, length), F.lit(0)))
    out = out.select("sid", "block", "copy", "take", F.floor(F.col("place") / shard).alias("shard"), F.pmod("place", F.lit(shard)).alias("slot"))
    return out.join(cut.where("first = 0").select("sid", "block"), ["sid", "block"], "left_semi")


def taken(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """placed and sources of place(), and a row a piece of a document in a slot: sid, start, from
    (word of the document), words, copy, shard."""
    placed, sources = place(docs)
    cut = pieces(placed)
    dealt = slots(cut, sources)
    both = cut.select("sid", "start", "block", "first", "words").join(dealt, ["sid", "block"])
    words = F.least(F.col("words"), F.col("take") - F.col("first"))
    begin = F.col("block") * BLOCK + F.col("first") - F.col("start")
    return placed, sources, both.withColumn("from", begin).withColumn("words", words).where("words > 0").select("sid", "start", "from", "words", "copy", "shard")


def mix(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken (words the mix takes, repeats
    counted) and first_shard, the first output shard with words of it (null: none).

    Sources in code point order, a null source last, weigh WEIGHTS in turn. A source's words are
    taken as close to its target as a whole number is, no document over MOST times. Null and empty
    texts have size 0 and nothing taken. Rows that repeat are documents of their own. The result
    depends on the rows alone, not on their order or partitions. No rows, or no words: nothing taken.
    """
    placed, sources, parts = taken(docs)
    sums = parts.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    out = placed.join(sums.withColumn("size_above", F.lit(True)), ["sid", "start"], "left")
    held = (F.col("size") > 0) & F.col("size_above")  # an empty document starts where the next one does
    out = out.join(sources.select("sid", "source_size", "target"), "sid")
    return out.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(F.when(held, F.col("taken")), F.lit(0)).alias("taken"), F.when(held, F.col("first_shard")).alias("first_shard"),
    )


def mixed_documents(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The documents the mix takes words of, with columns; text is those words with the white
    space around them, a second copy after a line end, and n_chars its length."""
    placed, _, parts = taken(docs)
    ranges = F.sort_array(F.collect_list(F.struct("copy", "from", "words")))
    parts = parts.groupBy("sid", "start").agg(ranges.alias("ranges"))
    parts = placed.where("size > 0").join(parts, ["sid", "start"])
    same = Window.partitionBy("doc_id", "th")
    parts = parts.select(
        F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "size", "ranges", F.row_number().over(same.orderBy("sid", "start")).alias("p_nr")
    )
    rows = rows_of(docs, *(c for c in columns if c not in ("doc_id", "text")))
    rows = rows.withColumn("nr", F.row_number().over(same.orderBy(F.col("source").isNull(), "source")))
    both = rows.join(parts, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")) & (F.col("nr") == F.col("p_nr")))
    words = F.regexp_extract_all("text", F.lit(f"({SPACE}*{WORD}{SPACE}*)"), F.lit(1))

    def copy(k: int) -> Column:
        mine = F.filter("ranges", lambda r: r["copy"] == k)
        n = F.aggregate(mine, F.lit(0).cast("long"), lambda a, r: a + r["words"])
        some = F.flatten(F.transform(mine, lambda r: F.slice(F.col("tokens"), (r["from"] + 1).cast("int"), r["words"].cast("int"))))
        return F.when(n == F.col("size"), F.col("text")).when(n > 0, F.array_join(some, ""))

    both = both.withColumn("tokens", words)
    out = both.withColumn("text", F.concat_ws("\n", *(copy(k) for k in range(MOST))))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs)
