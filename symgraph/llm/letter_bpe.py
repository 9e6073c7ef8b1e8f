"""Byte-pair merges of many words at once, for words of lower-case letters."""

from __future__ import annotations

import json

SLOTS = 1 << 18
LONGEST = 32
NONE = 1 << 30


def byte_names() -> list[str]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, more = [], 256
    for b in range(256):
        names.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return names


class LetterBpe:
    """The merges of a tokenizer file on bytes, whose words end in a suffix. Each step merges, in all words at once, the
    leftmost pair of the least rank, until no word has a pair to merge."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in names], np.int64)
        self.keys = np.full(SLOTS, -1, np.int64)
        self.keys[-1] = 0  # never a pair's, and no end of a search: of no rank
        self.ranks = np.full(SLOTS, NONE, np.int32)
        self.merged = np.zeros(SLOTS, np.int32)
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 20 | vocab[b]
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0 and self.keys[at] != key or at == SLOTS - 1:
                at = (at + 1) % SLOTS
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at], self.merged[at] = key, rank, vocab[a + b]

    @staticmethod
    def _slot(key):
        return ((key >> 20) * 0x9E3779B1 + (key & 0xFFFFF) * 0x85EBCA6B >> 7) % SLOTS

    def _found(self, a, b):
        """Slots of the merges of symbols a and b, -1 where there is none."""
        import numpy as np

        key = a << 20 | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))  # another pair is there: look further
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[(held >= 0) & ~hit]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to LONGEST bytes, as little-endian 32-bit integers."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == length)
            letters = np.frombuffer(b"".join([words[k] for k in members.tolist()]), np.uint8).reshape(-1, length)
            ids = np.concatenate([self.inner[letters[:, :-1]], self.last[letters[:, -1:]]], axis=1)
            where = members
            slot = self._found(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), length - 1)
            while len(ids):
                if ids.shape[1] == 1:
                    self._put(out, where, ids)
                    break
                rank = self.ranks[slot]  # slot -1 is the last one, which is kept without a merge
                best = rank.argmin(1)
                more = rank[np.arange(len(ids)), best] < NONE
                if not more.all():
                    self._put(out, where[~more], ids[~more])
                    where, ids, slot, best = where[more], ids[more], slot[more], best[more]
                if len(ids):
                    ids, slot = self._merge(ids, slot, best)
        return out

    def _merge(self, ids, slot, best):
        """Merges each word's pair at best: the word loses a symbol, and only the pairs beside it are looked up anew."""
        import numpy as np

        rows, width = np.arange(len(ids)), ids.shape[1]
        ids[rows, best] = self.merged[slot[rows, best]]
        columns = np.arange(width - 1)[None, :]
        ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
        if width == 2:
            return ids, slot[:, :0]
        columns = columns[:, : width - 2]
        slot = np.take_along_axis(slot, np.minimum(columns + (columns >= best[:, None]), width - 2), 1)
        left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
        a, b = best[left], best[right]
        slot[left, a - 1] = self._found(ids[left, a - 1], ids[left, a])
        slot[right, b] = self._found(ids[right, b], ids[right, b + 1])
        return ids, slot

    @staticmethod
    def _put(out: list[bytes], where, ids) -> None:
        data, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
        for k, at in enumerate(where.tolist()):
            out[at] = data[k * size : (k + 1) * size]
