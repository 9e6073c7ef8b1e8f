"""Packing: all documents' tokens one after the other, cut into sequences of a fixed length."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from unicodedata import normalize

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .letter_bpe import LONGEST as LONGEST_PLAIN
from .letter_bpe import LetterBpe

LENGTH = 2048
#: The id that ends a document.
END = 1
#: Stems whose ids a worker remembers, twice: the latest ones and those before; and bytes of one that it does.
REMEMBERED = 250_000
LONGEST = 48
#: Bytes of texts that are encoded together.
PORTION = 8_000_000
MARKS = b'.,;:!?*$%&#"()[]{}-_=+~/@^'
#: Characters below this one are Latin if they are letters.
PLAIN_BELOW = 0x250


class WordTokenizer:
    """Ids of whole texts by a tokenizer file whose tokens never reach over ASCII white space, whatever stands
    around it: a text's ids are its words' ids. Arrow splits texts into words and finds the different ones; of those,
    the stems, without the marks at their end, are few, and most have been seen before."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latest: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.letters = self._letters(path)

    def _letters(self, path: str) -> LetterBpe | None:
        """Merges for plain words, if the file's tokenizer is one of the kind: they must agree on its own vocabulary."""
        try:
            letters = LetterBpe(path)
        except (KeyError, TypeError):
            return None
        vocabulary = self.tokenizer.get_vocab()
        words = sorted({w.encode() for t in vocabulary if (w := re.sub("[^a-z]", "", t)) and len(w) <= LONGEST_PLAIN})
        words = words[:: max(1, len(words) // 2000)] + [chr(c).encode() for c in range(0xDF, PLAIN_BELOW) if chr(c) == chr(c).lower() and chr(c).isalpha()]
        return letters if letters.encode(words) == self._by_tokenizer(words) else None

    def _by_tokenizer(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 10_000):
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts[at : at + 10_000]], add_special_tokens=False)
            out += [array("I", x.ids).tobytes() for x in found]
        return out

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """Of plain words by merges alone: Latin letters, which lower-casing maps one to one and nothing composes."""
        plain, words, rest = [], [], []
        for k, t in enumerate(texts):
            if t.isalpha():  # bytes: ASCII letters
                low = t.lower()
            else:
                w = t.decode()
                low = w.lower().encode() if w.isalpha() and max(w) < chr(PLAIN_BELOW) and "\u0130" not in w else b""
            if low and self.letters and len(low) <= LONGEST_PLAIN:
                plain.append(k)
                words.append(low)
            else:
                rest.append(k)
        out: list[bytes] = [b""] * len(texts)
        if words:
            for k, ids in zip(plain, self.letters.encode(words), strict=True):
                out[k] = ids
        for k, ids in zip(rest, self._by_tokenizer([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    @staticmethod
    def _stems(words):
        """words, an Arrow array, without the marks at their end, where the tokenizer parts them: after a letter or
        digit. And whether a word has lost marks."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        stems = pc.ascii_rtrim(words, characters=MARKS.decode())
        offsets = np.frombuffer(stems.buffers()[1], np.int32)[stems.offset : stems.offset + len(stems) + 1]
        data = np.frombuffer(stems.buffers()[2] or b"", np.uint8)
        some = np.flatnonzero((np.diff(offsets) > 0) & (pc.binary_length(stems).to_numpy() < pc.binary_length(words).to_numpy()))
        last = data[offsets[some + 1] - 1]
        parted = np.zeros(len(stems), bool)
        parted[some] = np.array([chr(c).isalnum() for c in range(128)] + [False] * 128)[last]
        more = some[last >= 128]  # the last character isn't ASCII
        ends = stems.take(pa.array(more)).to_numpy(zero_copy_only=False)
        # As the tokenizer has it: \u0130 becomes two characters, and some others come apart, the last being no letter.
        parted[more] = [normalize("NFC", t[-1]).lower()[-1].isalnum() for t in ends]
        return pc.if_else(pa.array(parted), stems, words), parted

    def _ids_of_stems(self, stems: list[bytes]) -> list[bytes]:
        """Ids of different stems, remembered or new. As many as REMEMBERED are kept, then those of them that come again."""
        found = list(map(self.latest.get, stems))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in missing:
            found[k] = self.before.get(stems[k])
            if found[k] is None:
                new.append(k)
        for k, ids in zip(new, self._ids([stems[k] for k in new]), strict=True):
            found[k] = ids
        for k in missing:
            if len(stems[k]) <= LONGEST:
                if len(self.latest) >= REMEMBERED:
                    self.before, self.latest = self.latest, {}
                self.latest[stems[k]] = found[k]
        return found

    def _ids_of_words(self, words):
        """An Arrow array of the ids of different words: those of the stem, then those of the marks."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        as_bytes = lambda a: a.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        stems, parted = self._stems(words)
        coded = stems.dictionary_encode()
        n = len(coded.dictionary)
        marked = parted.nonzero()[0]
        whole, lengths = words.take(pa.array(marked)), pc.binary_length(stems).to_numpy()[marked].tolist()
        marks = pa.array([w[k:] for w, k in zip(as_bytes(whole), lengths, strict=True)], pa.binary()).dictionary_encode()
        table = as_bytes(coded.dictionary)
        known = set(table)
        extra = [m for m in as_bytes(marks.dictionary) if m not in known]
        table += extra
        ids = self._ids_of_stems(table)
        of = dict(zip(table, ids, strict=True))
        of_marks = pa.array([of[m] for m in as_bytes(marks.dictionary)] + [b""], pa.binary())
        mark = np.full(len(words), len(of_marks) - 1, np.int64)
        mark[marked] = marks.indices.to_numpy()
        of_stems = pa.array(ids[:n], pa.binary())
        return pc.binary_join_element_wise(of_stems.take(coded.indices), of_marks.take(pa.array(mark)), b"")

    def encode_all(self, texts, end: bytes = b""):
        """texts: an Arrow array of strings, no nulls. Another of each text's ids as 32-bit integers, little-endian
        as the machine's are, and after them end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)  # an empty word at white space at a text's ends has no ids
        coded = split.values.dictionary_encode()
        of_words = pa.concat_arrays([self._ids_of_words(coded.dictionary), pa.array([end], pa.binary())])
        ends = np.frombuffer(split.buffers()[1], np.int32)[split.offset + 1 : split.offset + len(split) + 1]
        ids = of_words.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(of_words) - 1)))
        at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[at]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), ids.buffers()[2]])

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def _portions(texts, size: int = PORTION) -> Iterator:
    """Arrow texts in order, about size bytes at a time."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = 1 + int(np.searchsorted(ends, size + (ends[at - 1] if at else 0)))
        to = min(to, len(texts))
        yield texts.slice(at, to - at)
        at = to


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """A worker's tokenizer, which keeps what it has learnt from task to task."""
    return WordTokenizer(path)


def _tokenized(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        tokenizer, number, ahead = tokenizer_of(path), TaskContext.get().partitionId(), 0
        end = END.to_bytes(4, "little")
        for batch in batches:
            at = 0
            for part in _portions(pc.fill_null(batch.column("text").cast(pa.string()), "")):
                ids = tokenizer.encode_all(part, end)
                ends = ahead + np.cumsum(pc.binary_length(ids).to_numpy() // 4, dtype=np.int64)
                starts, ahead = np.concatenate([[ahead], ends[:-1]]), int(ends[-1])
                columns = [batch.column("doc_id").slice(at, len(ids)), ids, pa.array([number] * len(ids), pa.int32()), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "part", "ahead"])
                at += len(ids)

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with END), part and ahead: the partition, and the ids before in it. Written once,
    so that both passes see the same partitions whatever is lost or run again."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(_tokenized(path), "doc_id long, ids binary, part int, ahead long"), "tokens", compression="zstd")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    First pass: token totals of the partitions; their prefix sums, a row a partition, give each
    partition's offset, and with the sums within it each document's place among all ids. Second pass:
    sequence k is ids k * length to (k + 1) * length, and a document that crosses a boundary has a
    piece on either side. Only the last sequence can need padding. Null and empty texts are END alone. Rows
    that repeat are packed each. No rows: no pieces.
    """
    rows = tokenized(docs, path)
    size = F.octet_length("ids") / 4
    totals = rows.groupBy("part").agg(F.sum(size.cast("long")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # A row a partition, of which a job has some millions at most: the ids stay where they are.
    placed = rows.join(F.broadcast(offsets), "part").select(
        "doc_id", "ids", size.cast("long").alias("doc_tokens"), (F.col("base") + F.col("ahead")).alias("at")
    )

    def piece(k):
        start = F.greatest(k * length - F.col("at"), F.lit(0))
        end = F.least((k + 1) * length - F.col("at"), F.col("doc_tokens"))
        ids = F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * (end - start)).cast("int"))
        return F.struct(start.alias("start"), (end - start).alias("length"), k.alias("sequence_id"), ids.alias("ids"))

    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("doc_tokens") - 1) / length)
    cut = placed.select("doc_id", "doc_tokens", "at", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select(
        "doc_id", "p.start", "p.length", F.crc32("p.ids").alias("ids_crc32"), "doc_tokens", "p.sequence_id",
        F.pmod(F.col("at") + F.col("p.start"), F.lit(length)).alias("offset"), "p.ids",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(docs, path or tokenizer_path()).drop("ids")
