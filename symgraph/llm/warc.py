"""WARC archives of pages, and the index of their captures merged into global order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, rekeyed, written

BREAK = "\r\n\r\n"
#: Records of an archive file, rows of a locally sorted run, and index rows that a task merges.
FILE_RECORDS = 5000
RUN = 50_000
MERGED = 100_000
#: Seconds since 1970 of the first capture; page n was captured n seconds later.
FIRST_CAPTURE = 1_704_067_200


def base32(hex40: Column) -> Column:
    """A SHA-1 in upper-case base32, from its 40 hex digits: five hex digits are four of base32."""
    groups = [F.lpad(F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), digest, bytes, response_id (null: the record is a response).

    Of pages with equal payloads of at least `least` bytes that with the largest page_id is the
    response. Payloads are equal if their SHA-1 and lengths are. Only ids and digests are grouped.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("th", F.xxhash64("html"))
    small = rows.select("page_id", "th", base32(F.sha1(F.col("html").cast("binary"))).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    small = written(small, "digests").distinct()  # rows that repeat are alike
    last = small.groupBy("th", "digest", "bytes").agg(F.max("page_id").alias("last"))
    last = last.select(rekeyed(F.col("th")).alias("k"), "digest", "bytes", "last")
    found = small.withColumn("k", rekeyed(F.col("th"))).join(last, ["k", "digest", "bytes"])
    other = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("last"))
    found = found.select(F.col("page_id").alias("f_id"), F.col("th").alias("f_th"), "digest", "bytes", F.when(other, F.col("last")).alias("response_id"))
    return rows.join(found, F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))).select("page_id", "url", "html", "digest", "bytes", "response_id")


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line ends in the value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(typed: DataFrame) -> DataFrame:
    """value: a WARC record without the break that ends it. A revisit has no payload of its own, but its digest and length."""
    revisit = F.col("response_id").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    payload = F.when(revisit, "").otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("X-Payload-Length", F.col("bytes")),
        _line("WARC-Refers-To", urn("response_id")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return typed.select(F.concat(head, F.lit(BREAK), payload).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Compressed WARC files in a new folder, by Spark's own writer: on any store it knows, and no
    file is seen of a task that was lost. Records end with two line ends, as the format has it."""
    options = {"compression": "gzip", "lineSep": BREAK, "maxRecordsPerFile": FILE_RECORDS}
    records(with_types(pages, least)).write.options(**options).text(path)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, path and query, without scheme, www and fragment."""
    rest = (url or "").strip().partition("#")[0]
    rest = rest.partition("://")[2] or rest
    cut = next((k for k, c in enumerate(rest) if c in "/?"), len(rest))
    host, path = rest[:cut].lower().rpartition("@")[2], rest[cut:] or "/"
    host = host.removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


class RecordReader:
    """Takes the pieces of archives between breaks, and gives (header, payload) of each record."""

    def __init__(self):
        self.head: dict[str, str] | None = None
        self.data, self.size = [], 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        sep = BREAK.encode()
        while True:
            if self.head is None:
                lines = piece.decode().split("\r\n")
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                self.data, self.size = [], -len(sep)
                return
            self.data.append(piece)
            self.size += len(sep) + len(piece)
            need = int(self.head["Content-Length"])
            if self.size < need:
                return
            whole = sep.join(self.data)
            head, self.head = self.head, None
            yield head, whole[:need]
            if len(whole) == need:
                return
            piece = whole[need + len(sep) :]  # the payload ended like a break: what follows it is the next head


INDEX = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run long"


def _urn(text: str | None) -> int | None:
    return int(text[len("<urn:page:") : -1]) if text else None


def _entry(head: dict[str, str], payload: bytes) -> tuple:
    import base64
    import hashlib

    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if head["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"the payload of {head.get('WARC-Record-ID')} isn't what its header says")
    key = (url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _urn(head.get("WARC-Record-ID")))
    return *key, size, digest, head["WARC-Type"], _urn(head.get("WARC-Refers-To"))


def _order(row: tuple) -> tuple:
    """By URL key, time and page; a row without page_id goes first, as in Spark."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def _runs(batches: Iterator) -> Iterator:
    """Index rows of a partition's records, in locally sorted runs."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in INDEX.split(", ")]
    reader, rows, run = RecordReader(), [], TaskContext.get().partitionId() << 32
    for b in batches:
        for piece in b.column("value").to_pylist():
            rows += [_entry(*r) for r in reader.feed(piece)]
            if len(rows) >= RUN:
                yield _batch([(*r, run) for r in sorted(rows, key=_order)], names)
                rows, run = [], run + 1
    if rows:
        yield _batch([(*r, run) for r in sorted(rows, key=_order)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index row of each record in a folder's archives, in sorted runs. Files are read as streams."""
    rows = spark.read.schema("value string").options(lineSep=BREAK).text(path)
    return rows.select(F.col("value").cast("binary")).mapInArrow(_runs, INDEX)


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of their matches, so that after the winner is
    taken only the matches on its leaf's way to the top are played again."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(len(runs)))
        winners += [-1] * (2 * self.k - len(winners))
        for node in range(self.k - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.k > 1 else (0 if runs else -1)

    def _head(self, r: int):
        return (self.key(self.runs[r][self.at[r]]), r) if self.at[r] < len(self.runs[r]) else None

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """The winner and the loser; a run that has ended loses."""
        if b < 0 or self.heads[b] is None:
            return a, b
        if a < 0 or self.heads[a] is None or self.heads[b] < self.heads[a]:
            return b, a
        return a, b

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            node = (w + self.k) // 2
            while node >= 1 and self.k > 1:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def _merged(batches: Iterator) -> Iterator:
    names = [x.split()[0] for x in INDEX.split(", ")]
    runs: dict[int, list[list]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = runs.setdefault(row[-1], [[]])
            if own[-1] and _order(row) < _order(own[-1][-1]):  # its parts came in another order
                own.append([])
            own[-1].append(row)
    out: list[tuple] = []
    for row in LoserTree([part for r in sorted(runs) for part in runs[r]], _order):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out, names)
            out = []
    if out:
        yield _batch(out, names)


def merged_index(index: DataFrame) -> DataFrame:
    """The captures of all runs in order of URL key, time and page, through all partitions.

    The index, which has no payloads, is written once and cut into key ranges of about MERGED rows;
    a range's parts of all runs meet in one task and are merged there. Ranges are of all three columns, so a URL
    with any number of captures spreads over several.
    """
    index = written(index, "index")
    parts = max(1, -(-index.count() // MERGED))
    spread = index.repartitionByRange(max(parts, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "url_key", "captured_at", "page_id")
    return spread.mapInArrow(_merged, INDEX)


def query(pages: DataFrame) -> DataFrame:
    """A row a page, read back from archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at.

    Null payloads are empty ones, null URLs are left out of the record and have the key of an empty URL. Rows
    that repeat a page_id with its payload are all responses or all revisits. No rows: no records.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    out = merged_index(read_index(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")
