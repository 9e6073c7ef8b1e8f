"""Chat formatting: reply trees, of which the best branches become conversations.

A conversation is written turn after turn as ``### role: text</turn>`` and a line end. Inside roles
and texts the control strings are escaped, so that ``</turn>`` only ends turns: a backslash
becomes ``\\b``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\t``, and in roles ``:`` becomes ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, written

#: The template's control strings and what stands for them, in the order of escaping.
OPEN, CLOSE = "### ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
COLON = (":", "\\c")
#: The role under the loss mask.
LEARNT = "assistant"
_MESSAGE = ("conv_id", "node", "parent", "role", "text", "score")


def _replaced(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    """Undoes escape(): every backslash starts an escape, and the backslash's own is undone last."""
    return _replaced(text, [(new, old) for old, new in reversed(ESCAPES)])


def _steps(messages: DataFrame) -> DataFrame:
    """A row a message and power of two up to its depth: conv_id, node, k, up (its ancestor 2^k steps
    up), total and steps (score and messages from it to below that ancestor).

    Each round joins the messages with themselves at their ancestors, so a path of n messages takes
    log2 n rounds. Messages in or under a cycle never end; after as many rounds as the
    largest conversation could need they are the only ones left, and stay behind.
    """
    here = messages.select("conv_id", "node", "parent", "score")
    parents = here.select(F.col("conv_id").alias("p_conv"), F.col("node").alias("p_node"))
    found = here.join(parents, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_node")), "left")
    now = written(found.select("conv_id", "node", F.lit(0).alias("k"), F.col("p_node").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "steps")
    out, ended = now, now.where("up IS NULL")
    largest = here.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(1, int(largest).bit_length() + 1):
        going = now.where("up IS NOT NULL")
        if going.isEmpty():
            break
        above = going.unionByName(ended).select(*(F.col(c).alias(f"a_{c}") for c in ("conv_id", "node", "up", "total", "steps")))
        both = going.join(above, F.col("conv_id").eqNullSafe(F.col("a_conv_id")) & (F.col("up") == F.col("a_node")))
        now = written(both.select("conv_id", "node", F.lit(k).alias("k"), F.col("a_up").alias("up"), (F.col("total") + F.col("a_total")).alias("total"), (F.col("steps") + F.col("a_steps")).alias("steps")), "steps")
        out, ended = out.unionByName(now), ended.unionByName(now.where("up IS NULL"))
    return out


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages: conv_id, node (distinct in it), parent (null or unknown: a root), role, text, score.

    Returns conv_id, path (1, 2, ... the best first), depth, role, text of the messages on the
    `branches` best root-to-leaf paths of each conversation: those of the highest score on average,
    then the longest, then of the least leaf. Messages on cycles are on no path.
    """
    messages = written(messages.select(*_MESSAGE), "messages")
    steps = _steps(messages)
    whole = steps.where("up IS NULL")  # each message once: all the way to its root
    parents = messages.where("parent IS NOT NULL").select(F.col("conv_id").alias("c_conv"), F.col("parent").alias("c_node")).distinct()
    leaves = whole.join(parents, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("node") == F.col("c_node")), "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    leaves = leaves.withColumn("path", F.row_number().over(best)).where(F.col("path") <= branches)
    on = written(leaves.select("conv_id", "path", "node", F.col("steps").alias("depth")), "paths")
    # With each power of two the messages that are on the path double, going up from the leaf.
    k = 0
    jumps = steps.where("up IS NOT NULL").select(F.col("conv_id").alias("j_conv"), F.col("node").alias("j_node"), F.col("k").alias("j_k"), "up")
    longest = on.agg(F.max("depth")).first()[0] or 0
    while 1 << k < longest:
        by = jumps.where(F.col("j_k") == k)
        more = on.join(by, F.col("conv_id").eqNullSafe(F.col("j_conv")) & (F.col("node") == F.col("j_node")))
        on = written(on.unionByName(more.select("conv_id", "path", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))), "paths")
        k += 1
    texts = messages.select(F.col("conv_id").alias("m_conv"), F.col("node").alias("m_node"), "role", "text")
    found = on.join(texts, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("node") == F.col("m_node")))
    return found.select("conv_id", "path", "depth", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """conv_id, path, text of the whole conversation, and spans: start and length, in bytes of the
    text's UTF-8, of what the loss is on, which is the escaped text of each assistant turn."""
    head = F.concat(F.lit(OPEN), _replaced(F.coalesce("role", F.lit("")), (*ESCAPES, COLON)), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    turns = paths.select("conv_id", "path", "depth", head.alias("head"), body.alias("body"), (F.col("role") == LEARNT).alias("learnt"))
    piece = F.concat("head", "body", F.lit(CLOSE))
    earlier = Window.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(earlier), F.lit(0).cast("long"))
    turns = turns.withColumn("piece", piece).withColumn("ahead", ahead)
    start = F.col("ahead") + F.octet_length("head")
    span = F.when(F.col("learnt"), F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length")))
    rows = turns.select("conv_id", "path", F.struct("depth", "piece", span.alias("span")).alias("t"))
    all_of = rows.groupBy("conv_id", "path").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return all_of.select("conv_id", "path", F.array_join("t.piece", "").alias("text"), F.array_compact("t.span").alias("spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, path, turns (role and text of each) and learnt (all text under the mask, in order),
    from the formatted text and spans alone."""
    segments = F.split("text", CLOSE)

    def turn(s: Column) -> Column:
        head = F.substring_index(s, ": ", 1)
        role = _replaced(F.substring(head, len(OPEN) + 1, 1 << 30), [COLON[::-1]])
        text = F.substring(s, F.char_length(head) + 3, F.char_length(s))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    turns = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), turn)
    cut = lambda data: F.transform(
        "spans", lambda p: unescape(F.substring(data, (p["start"] + 1).cast("int"), p["length"].cast("int")).cast("string"))
    )
    learnt = F.array_join(let(F.col("text").cast("binary"), cut), "")
    return conversations.select("conv_id", "path", "text", turns.alias("turns"), learnt.alias("learnt"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as a tree: each row answers the one before it by turn. Equal
    turns follow by role and text; a null turn comes first."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(by_turn).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return out.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, of which the texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("t")
    ).select("conv_id", "t.turn", "t.role", "t.text")


def digest(conversations: DataFrame) -> DataFrame:
    """A row a conversation, read back from its formatted text: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    A null conv_id is a conversation too; null roles and texts are empty ones. Rows that repeat are turns of
    their own, one after the other. No rows: no rows.
    """
    back = read_back(formatted(chosen_paths(as_messages(conversations))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return digest(rows.unionByName(extra_conversation(spark)))
