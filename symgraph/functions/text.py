"""Text functions: LIKE as the store has it, search terms, names, labels, previews, paths, hashes."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters trimmed off search terms, the pattern of identifiers, ASCII letters.
TERM_EDGES = " \t\r\n.,:;!?()[]{}<>\"'`"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_./:#()\-]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_TERM_BYTES = 3


def fold(text: Column) -> Column:
    """Lower case for ASCII letters only, as the store's LIKE compares."""
    return F.translate(text, UPPER, LOWER)


def py_fold(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def like(text: Column, pattern: str, literal: bool = False, prefix: bool = False) -> Column:
    """Case-insensitive LIKE '%pattern%' ('pattern%' with prefix). Per cent signs and underscores in the pattern
    are wildcards, as they are in the store; literal=True takes them as they stand."""
    body = py_fold(pattern)
    if literal or not re.search(r"[%_]", body):
        return fold(text).startswith(body) if prefix else fold(text).contains(body)
    body = body.replace("\\", "\\\\") + "%"
    return fold(text).like(body if prefix else "%" + body)


def like_escape(text: str) -> str:
    """The pattern that matches exactly this text under ESCAPE '\\'."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def any_of(predicates: list[Column]) -> Column:
    return reduce(or_, predicates)


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates)


def query_terms(query: str) -> list[str]:
    """Lower-cased words without punctuation at their ends, empty ones left out."""
    return [t for w in query.lower().split() if (t := w.strip(TERM_EDGES))]


def search_terms(query: str) -> list[str]:
    """Query terms of three bytes and more, each once, in order."""
    return list(dict.fromkeys(t for t in query_terms(query) if len(t.encode()) >= MIN_TERM_BYTES))


def search_terms_column(query: Column) -> Column:
    """search_terms() of each row."""
    trimmed = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.btrim(w, F.lit(TERM_EDGES)))
    return F.array_distinct(F.filter(trimmed, lambda t: F.octet_length(t) >= MIN_TERM_BYTES))


def is_identifier(query: str) -> bool:
    return re.match(IDENTIFIER, query) is not None and "\n" not in query


def is_identifier_column(query: Column) -> Column:
    return query.rlike(IDENTIFIER)


def _after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def display_name(symbol: Column, python: bool = False) -> Column:
    """The readable end of a symbol: without path, descriptors and argument lists. In Python's form colons,
    hashes and dots divide nothing. What would leave nothing leaves the symbol."""
    symbol = F.btrim(symbol, F.lit(" \t\r\n"))
    name = _after_last(F.rtrim(symbol, F.lit(".#:/!")), "/")
    name = name if python else _after_last(name, ":")
    name = F.regexp_replace(F.regexp_replace(name, r"\)\.$", ""), r"\(\)$", "")
    name = F.btrim(F.substring_index(name, "(", 1), F.lit("`"))
    if not python:
        name = F.when(name.rlike(r"[#.][^#.]+$"), F.regexp_extract(name, r"([^#.]+)$", 1)).otherwise(name)
    local = F.btrim(F.regexp_replace(symbol, "^local ", ""))
    return F.when(symbol.startswith("local "), local).when(name != "", name).otherwise(symbol)


def enum_label(name: Column, prefix: str = "", suffix: str = "") -> Column:
    """CamelCase as snake_case, without the enum's affixes; unspecified kinds are empty."""
    bare = F.regexp_replace(name, f"^{re.escape(prefix)}", "") if prefix else name
    bare = F.regexp_replace(bare, f"{re.escape(suffix)}$", "") if suffix else bare
    label = F.btrim(F.lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1_$2")), F.lit("_"))
    return F.when(label.like("unspecified%"), "").otherwise(label)


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes, less a character that they cut."""
    cuts = [F.try_validate_utf8(F.substring(text.cast("binary"), 1, n - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def doc_summary(documentation: Column) -> Column:
    """Documentation lines joined, trimmed, 400 bytes at most."""
    return first_bytes(F.btrim(F.array_join(documentation, "\n"), F.lit(" \t\r\n")), 400)


def header_text(text: Column) -> Column:
    """The first line, trimmed, 160 bytes at most."""
    return first_bytes(F.btrim(F.substring_index(text, "\n", 1), F.lit(" \t\r")), 160)


def chunk_key(path: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat_ws(":", path, start.cast("string"), end.cast("string"), kind)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def line_count(text: Column) -> Column:
    """Line ends, and one more if the text doesn't end with one; an empty text has no line."""
    ends = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def strip_code_fences(text: Column) -> Column:
    """Lines trimmed and joined with a blank, without empty ones and those that open or close code."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("```")), " ")


def flatten_doc(text: Column) -> Column:
    """White space collapsed; a code fence's first and last lines are left out where the text opens with one."""
    inner = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^```[^\n]*\n", "\n")
    inner = F.when(F.btrim(text, F.lit(" \t\r\n")).rlike(r"^```[^\n]*\n"), F.regexp_replace(inner, r"\n\s*```$", "")).otherwise(inner)
    return F.btrim(F.regexp_replace(inner, r"[ \t\r\n\x0B\f]+", " "))


def first_non_empty(*values: Column) -> Column:
    """The first that isn't blank, as it stands; else empty."""
    return F.coalesce(*(F.when(F.btrim(v, F.lit(" \t\r\n")) != "", v) for v in values), F.lit(""))


def display_path(path: Column, root: str) -> Column:
    """Below the root, or relative, with ./ in front; other paths as they are."""
    root = root.rstrip("/")
    below = F.concat(F.lit("./"), F.substring(path, len(root) + 2, 1 << 20))
    as_is = path.startswith("/") | path.startswith("./") | path.startswith("../")
    return F.when(path.startswith(root + "/"), below).when(as_is, path).otherwise(F.concat(F.lit("./"), path))


def kind_label(kind: Column) -> Column:
    """Chunk kinds for people: no underscores and grammar words, short forms written out, capitals."""
    label = F.lower(F.btrim(F.replace(kind, F.lit("_"), F.lit(" "))))
    for word in (" declaration", " definition", " item"):
        label = F.regexp_replace(label, f"{word}$", "")
    label = F.initcap(F.regexp_replace(label, " +", " "))
    out = F.when(label == "", "Result")
    for short, long in (("Func", "Function"), ("Var", "Variable"), ("Impl", "Implementation")):
        out = out.when(label == short, long)
    return out.otherwise(label)


def code_preview(text: Column, n: int = 120) -> Column:
    """The first line up to a brace, and dots where it is longer than n bytes."""
    edge = F.lit(" \t\r\n")
    line = F.btrim(F.substring_index(F.btrim(text, edge), "\n", 1), edge)
    line = F.when(F.instr(line, "{") > 0, F.btrim(F.regexp_replace(F.substring_index(line, "{", 1), ";$", ""), edge)).otherwise(line)
    return F.when(F.octet_length(line) > n, F.concat(F.btrim(first_bytes(line, n), edge), F.lit("..."))).otherwise(line)


def truncate_lines(text: Column, n: int) -> Column:
    """The first n lines, and how many more there are."""
    lines = F.split(text, "\n")
    more = F.concat(F.lit("\n\n... ("), (F.size(lines) - n).cast("string"), F.lit(" lines left out)"))
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), more)).otherwise(text)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def artifact_suffix(name: Column) -> Column:
    """Lower case; anything but letters and digits becomes an underscore, none at the ends."""
    out = F.btrim(F.regexp_replace(F.lower(F.btrim(name)), "[^a-z0-9]", "_"), F.lit("_"))
    return F.when(out == "", "workspace").otherwise(out)


def unit_name(name: Column, default: str) -> Column:
    trimmed = F.btrim(name, F.lit(" \t\r\n"))
    return F.when(trimmed.isin("", "."), default).otherwise(F.replace(trimmed, F.lit(" "), F.lit("-")))


def renamed_paths(path: Column) -> Column:
    """Of a diff's path: [old, new] for renames in either form, else the path alone; empty ones left out."""
    path = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")))
    braces, plain = r"^([^{]*)\{(.*?)=>(.*)\}([^}]*)$", r"^(.*?)=>(.*)$"
    part = lambda k, p: F.regexp_extract(path, p, k)
    inner = [F.btrim(F.concat(part(1, braces), F.btrim(part(k, braces)), part(4, braces))) for k in (2, 3)]
    outer = [F.btrim(part(k, plain)) for k in (1, 2)]
    both = F.when(path.rlike(braces), F.array(*inner)).when(path.rlike(plain), F.array(*outer)).otherwise(F.array(path))
    return F.array_distinct(F.filter(both, lambda p: p != ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def clean_path(path: Column) -> Column:
    """Slashes one way, no doubled ones, no . and no step down and up again, at any depth. A slash at the end stays."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(out, "/"), lambda p: ~p.isin("", "."))
    rooted = out.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (part == "..") & (F.size(done) > 0) & (last != "..")
        above_root = (part == "..") & (F.size(done) == 0) & rooted
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(above_root, done).otherwise(F.array_append(done, part))

    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    clean = F.when((clean != "") & out.endswith("/"), F.concat(clean, F.lit("/"))).otherwise(clean)
    return F.when(rooted, F.concat(F.lit("/"), clean)).when(clean == "", ".").otherwise(clean)


def inside_root(path: Column) -> Column:
    return ~(path.startswith("../") | (path == "..") | path.startswith("/"))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def symbol_text(kind: Column, name: Column, signature: Column, doc: Column) -> Column:
    """A symbol's retrieval text: labelled lines, empty parts left out."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", part("Kind: ", kind), part("Name: ", name), part("Signature: ", signature), part("Doc: ", doc))


def symbol_record_text(symbols) -> Column:
    """A symbol's text to be embedded: a line a part, with its label, empty ones left out but for the name."""
    part = lambda label, c: F.when(symbols[c] != "", F.concat(F.lit(f"\n{label}: "), symbols[c])).otherwise("")
    parts = (("kind", "kind"), ("file", "file_path"), ("enclosing", "enclosing_symbol"), ("signature", "signature"), ("doc", "doc_summary"), ("scip", "scip_symbol"))
    return F.concat(F.lit("symbol: "), F.coalesce(symbols["display_name"], F.lit("")), *(F.coalesce(part(*p), F.lit("")) for p in parts))
