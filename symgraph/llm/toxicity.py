"""Toxicity: words written to evade filters are restored by Viterbi decoding, then the text is scored.

What was written is taken for a word that went through a noisy channel: letters became look-alikes,
were repeated, or set apart. Each span with a letter that has look-alikes, repeats or gaps becomes a lattice,
a row of slots with the strings each may stand for and their costs; the path of least cost under a character
trigram model, counted over all documents, is the restored text. Three letters can't tell a word's punctuation
from its letters, nor a doubled letter from a repeated one: the text is scored with the word as it stands, with
what is restored of it with and without the look-alikes at its ends, and with doubled look-alikes left double.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .linear import SAMPLE, Fit, fitted, held_out, labelled, sigmoid

FIT = Fit(bits=20, epochs=3, alpha=0.3, l1=8.0, l2=0.5)
THRESHOLD = 0.5
REMEMBERED = 200_000
#: Symbols of the character model: 0 what is no letter, 1 to 26 a to z, 27 any other letter.
SYMBOLS = 28

#: Letters that characters stand for in look-alike writing.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SIGNS = "".join(c for c in LOOKALIKES if not c.isalnum())
#: Costs in nats of what the channel does: a look-alike written or left as it is, a letter repeated, a gap,
#: a gap of a look-alike.
LOOKALIKE, LITERAL, REPEAT, GAP, KEPT_GAP, LOOKALIKE_GAP = 1.5, 8.0, 0.5, 0.2, 2.0, 4.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[^\W\d_]")
_LOOKS = re.compile(r"[013456789@$!|+(€£¡*]")
_REPEATS = re.compile(r"([^\W\d_])\1")
_DOUBLED = re.compile(r"([^\W_]|[@$!|+(€£¡*])\1")
#: Letters, each perhaps repeated, with separators between them, of any kind and number; in the first, look-alikes are letters.
_APART = re.compile(r"(?<![\w'’])(?:(?:([^\W_])\1*|[@$!|+(€£¡])(?:_|[^\w@$!|+(€£¡])+){2,}(?:([^\W_])\2*|[@$!|+(€£¡])(?!\w)")
#: Letters of which none stands twice in a row.
_SINGLE = re.compile(r"(?:([^\W\d_])(?!\1))+")
_JOINED = re.compile(r"(?:([^\W_])\1*[\W_]+){2,}([^\W_])\2*")
#: ASCII marks that are no look-alikes.
_MARKS = "\"#%&'),-./:;<=>?[\\]^`{}~"


def bare(word: str) -> str:
    """The word without what is no letter or digit at its ends; @ and $ stay, but two or more of them at the end go.

    From each end inwards, each character once: a pattern for this can take exponential time on
    marks inside a word.
    """
    start, end = 0, len(word)
    while start < end and not (word[start].isalnum() or word[start] in "_@$"):
        start += 1
    while start < end:
        c = word[end - 1]
        if c.isalnum() or c == "_":
            break
        run = end - 1
        if c in "@$":
            while run > start and word[run - 1] == c:
                run -= 1
            if end - run < 2:
                break
        end = run
    return word[start:end]


def outer(word: str) -> str:
    """The word without what is neither letter, digit nor look-alike at its ends."""
    start, end = 0, len(word)
    while start < end and not (word[start].isalnum() or word[start] == "_" or word[start] in SIGNS):
        start += 1
    while start < end and not (word[end - 1].isalnum() or word[end - 1] == "_" or word[end - 1] in SIGNS):
        end -= 1
    return word[start:end]


def symbol_table():
    """Symbols of the first characters; those beyond are other letters."""
    import numpy as np

    table = np.full(0x300, 27, np.uint8)
    for c in range(0x300):
        table[c] = _symbol(chr(c).lower()[0])
    return table


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class _Symbols(dict):
    """Symbols of characters, kept once they are known."""

    def __missing__(self, c: str) -> int:
        self[c] = s = _symbol(c)
        return s


_SYMBOL_OF = _Symbols()


def _cut(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text between blanks, in pieces that overlap by the two characters before."""
    text = f"  {text} "
    return (text[at : at + size + 2] for at in range(0, len(text) - 2, size))


def _counts(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    table, total = symbol_table(), np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for piece in (p for t in b.column("text").to_pylist() for p in _cut(t or "")):
            codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            s = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 27).astype(np.int64)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame):
    """Costs in nats of a symbol after two others, counted over all documents' whole texts. There
    are at most SYMBOLS cubed counts, whatever the number of documents."""
    import numpy as np

    counts = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for row in counts.collect():
        n[row.gram] = row.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = (n.sum(0) + 0.1) / (n.sum(0) + 0.1).sum(1, keepdims=True)  # the symbol given the one before
    after = (n + 20 * pairs[None]) / (n.sum(2, keepdims=True) + 20)
    return -np.log(after)


def lattice(span: str, doubled: bool = False) -> list[list[tuple[str, float]]]:
    """Slots of (string, cost) for a lower-cased span; doubled: what repeats isn't one letter."""
    slots, at = [], 0
    apart = bool(_APART.fullmatch(span) or _JOINED.fullmatch(span))
    first, last = len(span) - len(span.lstrip(SIGNS)), len(span.rstrip(SIGNS))
    while at < len(span):
        c = span[at]
        if (plain := _SINGLE.match(span, at)) and plain.group().isalpha():  # one path
            slots.append([(plain.group(), 0.0)])
            at = plain.end()
            continue
        run = at + 1
        while run < len(span) and span[run] == c:
            run += 1
        n = run - at
        if c.isalpha():
            options = [(c * n, 0.0)]
            if n > 2:
                options = [(c, REPEAT * 2), (c * 2, REPEAT), (c * n, REPEAT * n)][doubled:]
            elif n == 2 and not doubled:
                options = [(c * 2, 0.0), (c, REPEAT)]
        elif apart and not c.isalnum() and c not in LOOKALIKES:
            options = [("", GAP), (" ", KEPT_GAP)]
        else:
            # As a sign at an end of the span it's punctuation, no part of the word.
            options = [(c * n if first <= at < last else "", LITERAL)]
            for x in LOOKALIKES.get(c, ""):
                options += ([] if doubled and n > 1 else [(x, LOOKALIKE)]) + ([(x * 2, LOOKALIKE)] if n > 1 else [])
            if apart and not c.isalnum():
                options.append(("", GAP if c == "*" else LOOKALIKE_GAP))
        if slots and len(options) == len(slots[-1]) == 1:  # one path: one slot
            ((a, x),), ((b, y),) = slots[-1], options
            slots[-1] = [(a + b, x + y)]
        else:
            slots.append(options)
        at = run
    return slots


def decode(span: str, costs, doubled: bool = False) -> str:
    """The string of least cost, by Viterbi over the last two symbols; of equal ones the first in order.

    After two symbols of a slot with one string all paths are in one state: what follows in the slot
    costs them the same and isn't added up.
    """
    symbol_of = _SYMBOL_OF
    best = [(0, 0, 0.0, None)]  # the last two symbols, cost and the path's end, a linked list
    for options in [*lattice(span.lower(), doubled), [(" ", 0.0)]]:
        now: dict = {}
        if len(options) == 1 and len(string := options[0][0]) > 1:
            x, y = symbol_of[string[0]], symbol_of[string[1]]
            path = best[0][3]
            if len(best) > 1:
                path = min(best, key=lambda v: v[2] + costs[v[0]][v[1]][x] + costs[v[1]][x][y])[3]
            best = [(symbol_of[string[-2]], symbol_of[string[-1]], 0.0, (string, path))]
            continue
        for string, more in options:
            codes = [symbol_of[letter] for letter in string]
            for a, b, cost, path in best:
                c = cost + more
                for s in codes:
                    c += costs[a][b][s]
                    a, b = b, s
                key = a * SYMBOLS + b
                if (old := now.get(key)) is None or c < old[2]:
                    now[key] = (a, b, c, (string, path))
        best = list(now.values())
    path = min(best, key=lambda v: v[2])[3]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))[:-1]


class Restorer:
    """Words of a text in lower case, as they stand and deobfuscated."""

    def __init__(self, costs):
        self.costs = costs.tolist()  # plain lists are quicker than arrays to index one by one
        self.known: dict[str, tuple[str, ...]] = {}

    def _readings(self, form: str) -> tuple[str, ...]:
        """What a form decodes to, which words that differ in their edges and case share."""
        found = self.known.get(form)
        if found is None:
            found = tuple(decode(form, self.costs).split())
            if _LOOKS.search(form) and _DOUBLED.search(form):
                found += tuple(decode(form, self.costs, True).split())
            if len(form) < 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[form] = found
        return found

    def span(self, word: str) -> tuple[str, ...]:
        """Of a word or of letters set apart, which only count in lower case and without marks at their ends:
        as it stands, and its readings."""
        word = word.lower().strip(_MARKS)
        if word.isalpha():  # as most words are
            return tuple(dict.fromkeys((word, *self._readings(word)))) if _REPEATS.search(word) else (word,)
        inner, wide = bare(word), outer(word)
        found = inner.split()
        if _LETTER.search(wide):
            for form in dict.fromkeys((inner, wide)):
                if _LOOKS.search(form) or _REPEATS.search(form) or _APART.fullmatch(form) or _JOINED.fullmatch(form):
                    found += self._readings(form)
        return tuple(dict.fromkeys(x for w in found if (x := bare(w))))

    @staticmethod
    def written(text: str) -> set[str]:
        """The words of a text, and its runs of letters set apart, each once."""
        out = set(_WORD.findall(text))
        out.update(m.group() for m in _APART.finditer(text))
        return out

    def words(self, text: str) -> set[str]:
        return {x for w in self.written(text) for x in self.span(w)}


def _ids(word: str, bits: int) -> list[int]:
    """Features of a word: itself and its beginnings."""
    low, n = 32 - bits, len(word)
    out = [xxh32_intdigest(word.encode()) >> low]
    if n >= 4:
        out += [xxh32_intdigest((word[:k] + "~").encode()) >> low for k in range(4, min(n, 7) + 1)]
    return out


def features(costs, bits: int) -> Callable:
    """For fitted(): (ids, values) of each text, each feature that occurs counting one."""

    def run(texts: list[str]) -> Iterator[tuple]:
        import numpy as np

        restorer = Restorer(costs)
        for t in texts:
            ids = np.unique(np.array([i for w in restorer.words(t) for i in _ids(w, bits)], np.int32))
            yield ids, np.ones(len(ids), np.float32)

    return run


def scorer(costs, weights, bits: int) -> Callable:
    """texts -> scores. What a word adds is remembered by the word as written and by its form; words that add
    nothing, as most do, are left out of the work at once."""
    restorer, light, forms = Restorer(costs), set(), {}
    weight_of = {int(i): float(weights[i]) for i in weights[:-1].nonzero()[0]}
    bias, none = float(weights[-1]), {}

    def features_of(form: str) -> dict[int, float]:
        own = forms.get(form)
        if own is None:
            own = {i: weight_of[i] for w in restorer.span(form) for i in _ids(w, bits) if i in weight_of} or none
            if len(form) < 64:
                if len(forms) >= REMEMBERED:
                    forms.clear()
                forms[form] = own
        return own

    def score(text: str) -> float:
        found: dict[int, float] = {}
        for w in restorer.written(text).difference(light):
            own = features_of(w.lower().strip(_MARKS))
            if own:
                found.update(own)
            elif len(w) < 64:
                if len(light) >= 2 * REMEMBERED:
                    light.clear()
                light.add(w)
        return sigmoid(bias + sum(found[i] for i in sorted(found)))

    return lambda texts: [score(t or "") for t in texts]


def model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, fit: Fit = FIT) -> tuple:
    """The character model of all documents, and weights learnt from at most limit labelled ones."""
    costs = character_model(docs)
    return costs, fitted(labelled(docs, labels, "toxic", limit), features(costs, fit.bits), fit)


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD, fit: Fit = FIT) -> DataFrame:
    """A row a document: doc_id, held_out, score (0 to 1, higher: toxic 1 likelier), predicted.

    Whole texts are decoded and scored; null and empty ones have the bias alone. Without labels all
    scores are 0.5, and predicted 1. A null doc_id is in no fold and has no label. Rows that
    repeat are scored each. No rows: no rows. Only the model, of fixed size, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels, limit, fit))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = scorer(*sent.value, fit.bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
