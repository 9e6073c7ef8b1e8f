"""Small tables with everything that may go wrong."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, k long, size long, `text_sha256` string, ids string, sid long"


def spoilt(rows):
    """Rows of documents with further columns of names that the operators use themselves."""
    return [(*r, "x", 1, 2, "y", "z", None) for r in rows]


def awkward_rows():
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows, shared lines."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [line(8) for _ in range(3)]
    texts = [None, "", " \n\t", "one", "One", "\n\n", "a\x1cb c", "É É É É", "x " * 3, "&*|# <>"]
    base = line(150)
    texts += [base, base.upper(), base.replace(vocabulary[0], "zz"), base + " end", base]
    texts += ["\n".join([line(12), shared[k % 3], line(30), "  " + shared[0].upper() + "\t"]) for k in range(20)]
    texts += [line(20000), "\n".join(line(5) for _ in range(3000)), "w " * 9000, line(60) + "\n" + line(8) * 1]
    texts += ["\n".join([x := line(9), line(9), x, line(40), x]), "naïve café 日本語 " * 20]
    rows = [(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[20], (None, "null id", "en", "s1", 7), (None, base, None, None, None), (900, line(50), None, None, None)]
    rows += [(901, rows[20][1], "en", "s0", 3), (902, line(30), "en", "", 3), (-5, line(30), "en", "s\U0001f600", 3), (-6, line(30), "en", "s￮", 3)]
    return rows
