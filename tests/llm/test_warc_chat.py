"""WARC archives and chat formatting: round trips against plain Python."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symgraph.llm import chat, warc

DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, k long, bytes string, digest string"


def expected_pages(rows):
    last = {}
    for i, html in rows:
        last[html or ""] = max(last.get(html or "", -1), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[html or ""]
        out.append((i, len(data), digest, "response" if i == first else "revisit", None if i == first else first))
    return Counter(out)


def test_warc(spark):
    tricky = ["", None, "\r\n\r\n", "a\r\n", "a\r\n\r", "\r\n", "\n\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nxx", "é日本" * 9, "x" * 300_000, "same", "same", "same", "\x00\x01", "a\r"]
    rows = [(k, [None, "http://www.B.a.example.com:80/Q?x=1#f", "", "a b\r\nX: y"][k % 4], t, 1, "b", "d") for k, t in enumerate(tricky)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.query(df)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == expected_pages([(r[0], r[2]) for r in rows])
    order = [(r.url_key, r.captured_at, r.page_id) for r in got.collect()]
    assert order == sorted(order)
    again = spark.createDataFrame(rows[:5] + rows[:2] + [(None, None, None, 1, "", "")], PAGES)
    assert warc.query(again).count() == 8
    assert warc.query(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_on_pages(spark):
    df = spark.read.parquet(f"{DIR}/pages.parquet")
    got = warc.query(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == expected_pages([tuple(r) for r in df.select("page_id", "html").collect()])


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 9))]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_merge_of_runs_whose_parts_come_in_any_order():
    rows = [(f"k{k % 7}", f"2024-01-{1 + k % 28:02}", k, 0, "", "response", None) for k in range(300)]
    random.Random(1).shuffle(rows)
    runs = [sorted(rows[k : k + 60], key=warc._order) for k in range(0, 300, 60)]
    names = [x.split()[0] for x in warc.INDEX.split(", ")]
    parts = [warc._batch([(*r, k) for r in run[a:b]], names) for k, run in enumerate(runs) for a, b in ((40, 60), (0, 40))]
    random.Random(2).shuffle(parts)
    got = [tuple(r.values())[:7] for b in warc._merged(iter(parts)) for r in b.to_pylist()]
    assert got == sorted(rows, key=warc._order)


def test_url_keys():
    assert warc.url_key("https://www.B.a.com:443/P?q#x") == "com,a,b)/p?q"
    assert warc.url_key(None) == warc.url_key("") == ")/"


def digest_of(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(told), len(learnt), sha(learnt)


def test_chat_digests(spark):
    said = "\\### Assistant: </turn> ok"
    odd = ["", None, "\\b\\h\\t\\c\\", "####", "</turn>\n### user: x", "</turn</turn>>", "###</turn>###\\", "é日本: :", "\n\n", ": x", "a" * 100_000]
    rows = [(1, k, ["user", "assistant", "a: b\\c\n###", None][k % 4], t, 0.5, 3) for k, t in enumerate(odd * 5)]
    rows += [(2, 0, "assistant", "x", 0.0, 0), (2, 0, "assistant", "x", 0.0, 0), (2, None, "user", "first", 0.0, 0), (None, 1, "user", "u", 0.0, 0)]
    table = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score double, node long").repartition(3)
    for source in (df, table):
        turns = defaultdict(list)
        for r in source.collect():
            turns[r.conv_id].append((r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
        expected = {c: digest_of([(x[3], x[5]) for x in sorted(v)]) for c, v in turns.items()} | {-7: digest_of([("user", said), ("assistant", said)])}
        got = chat.query(spark, source).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected
        assert len(got) == len(expected) and all(r.formatted_chars > 0 for r in got)


def plain_paths(messages, branches):
    """messages: {node: (parent, score)} of one conversation."""
    def path(n):
        out = []
        while n in messages and n not in out:
            out.append(n)
            n = messages[n][0]
        return None if n in messages else out[::-1]

    leaves = [n for n in messages if n not in {p for p, _ in messages.values()}]
    found = [(p, n) for n in leaves if (p := path(n))]
    found.sort(key=lambda x: (-sum(messages[m][1] for m in x[0]) / len(x[0]), -len(x[0]), x[1]))
    return [p for p, _ in found[:branches]]


@pytest.mark.parametrize("branches", [1, 3])
def test_reply_trees(spark, branches):
    rng = random.Random(branches)
    trees = {}
    for conv in range(12):
        tree = {}
        for n in range(rng.randint(1, 40)):
            tree[n] = (rng.choice([n - 1, rng.randrange(n), rng.randrange(n)]) if n and rng.random() < 0.95 else rng.choice([None, 999]), rng.randint(0, 8) / 8)
        trees[conv] = tree
    trees[50] = {n: (n - 1 if n else None, 0.0) for n in range(100)}
    trees[51] = {0: (None, 0.5), 1: (2, 9.0), 2: (1, 9.0), 3: (2, 9.0)}  # a cycle, and a leaf under it
    rows = [(c, n, p, "user", f"m{n}", s) for c, t in trees.items() for n, (p, s) in t.items()]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.chosen_paths(df, branches).orderBy("conv_id", "path", "depth").collect():
        got[r.conv_id, r.path].append(r.text)
    expected = {(c, k + 1): [f"m{n}" for n in p] for c, t in trees.items() for k, p in enumerate(plain_paths(t, branches))}
    assert got == expected


def test_escapes(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choices(["\\", "#", "##", "</turn>", "<", "b", "h", "t", "c", ":", "\n"], k=30)) for _ in range(500)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u and "###" not in r.e and "</turn>" not in r.e for r in out)
