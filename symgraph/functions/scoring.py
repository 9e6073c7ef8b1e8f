"""Scoring functions of the ranking algebra."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Weights of edge kinds and of roles at query time, and of roles in links.
EDGE_WEIGHTS = {
    "calls": 1.0, "reference": 0.95, "implementation": 0.9, "type_definition": 0.8, "writes": 0.7,
    "reads": 0.65, "uses": 0.6, "imports": 0.55, "contains": 0.4,
}
ROLE_WEIGHTS = {"defines": 1.0, "writes": 0.8, "reads": 0.7, "imports": 0.65, "uses": 0.6}
LINK_WEIGHTS = {"defines": 1.0, "imports": 0.65, "writes": 0.75, "reads": 0.6, "uses": 0.55}
OTHER, OUTGOING = 0.5, 0.9
#: Kinds that rank lower or higher, and lines beyond which a chunk's score shrinks.
IMPORT_KINDS = ("import_statement", "import_from_statement")
DEFINING_KINDS = ("function_definition", "method_definition", "class_definition", "class_declaration", "interface_declaration")
LONG_CHUNK = 40
EXACT_BOOST = 120.0
SPECIFICITY = {
    "function": 5.0, "method": 5.0, "class": 4.0, "interface": 3.5, "type": 3.0, "type_alias": 3.0,
    "variable": 2.0, "property": 2.0, "module": 1.0,
}


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in reversed(values.items()):
        out = F.when(key == name, value).otherwise(out)
    return out


def edge_weight(kind: Column, direction: Column) -> Column:
    return looked_up(kind, EDGE_WEIGHTS, OTHER) * F.when(direction == "outgoing", OUTGOING).otherwise(1.0)


def role_weight(role: Column) -> Column:
    return looked_up(role, ROLE_WEIGHTS, OTHER)


def similarity(distance: Column) -> Column:
    return F.when(distance <= 0, 1.0).otherwise(1.0 / (1.0 + distance))


def rank_weight(rank: Column) -> Column:
    """Of a rank that counts from zero."""
    return 1.0 / (rank + 1).cast("double")


def seed_share(weight: Column) -> Column:
    return F.when(weight <= 0, 0.0).otherwise(weight / EXACT_BOOST)


def reranked(score: Column, kind: Column, start_line: Column, end_line: Column) -> Column:
    """Modules and imports count less, definitions more, chunks of many lines in proportion."""
    by_kind = F.when(kind == "module", 0.3).when(kind.isin(*IMPORT_KINDS), 0.45).when(kind.isin(*DEFINING_KINDS), 1.15).otherwise(1.0)
    span = F.greatest(end_line - start_line + 1, F.lit(1))
    return score * by_kind * F.when(span > LONG_CHUNK, LONG_CHUNK / span.cast("double")).otherwise(1.0)


def context_seed_score(score: Column, kind: Column, name: Column, start_line: Column, end_line: Column, query: str, identifier: bool) -> Column:
    by_kind = F.when(kind.isin(*DEFINING_KINDS), 1.3).when(kind == "module", 0.22).when(kind.isin(*IMPORT_KINDS), 0.35).otherwise(1.0)
    exact = F.when(name == query, 1.6).otherwise(1.0) if identifier else F.lit(1.0)
    return reranked(score, kind, start_line, end_line) * by_kind * exact


def specificity(path: Column, kind: Column, doc: Column, start_line: Column, end_line: Column) -> Column:
    span = end_line - start_line + 1
    return (
        F.when(path != "", 10.0).otherwise(0.0) + looked_up(kind, SPECIFICITY, 0.0)
        + F.when(doc != "", 1.0).otherwise(0.0) + F.when(span > 0, 1.0 / span.cast("double")).otherwise(0.0)
    )


def softmax(score: Column, temperature: float = 1.0, over: Window | None = None) -> Column:
    """Shares of exp((score - highest) / temperature) over the window, by default all rows."""
    over = over or Window.partitionBy()
    t = temperature if temperature > 0 else 1.0
    weight = F.exp((score - F.max(score).over(over)) / t)
    weight = F.when(F.isnan(weight), 0.0).otherwise(weight)
    total = F.sum(weight).over(over)
    return F.when(total > 0, weight / total).otherwise(1.0 / F.count(F.lit(1)).over(over))


def changed_ratio(changed: Column, total: Column) -> Column:
    ratio = F.least(changed.cast("double") / total, F.lit(1.0))
    return F.when(changed <= 0, 0.0).when(total <= 0, 1.0).otherwise(ratio)


def has_bit(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


#: Bits of symbol roles.
DEFINITION, IMPORT, WRITE, READ, GENERATED, TEST, FORWARD = 1, 2, 4, 8, 16, 32, 64


def decoded_range(r: Column) -> Column:
    """Three numbers are a range on one line, four a full one; anything else is an error."""
    full = lambda a, b, c, d: F.struct(r[a].alias("start_line"), r[b].alias("start_col"), r[c].alias("end_line"), r[d].alias("end_col"))
    bad = F.raise_error(F.concat(F.lit("a range has 3 or 4 numbers, not "), F.size(r).cast("string")))
    kind = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
    return F.when(F.size(r) == 3, full(0, 1, 0, 2)).when(F.size(r) == 4, full(0, 1, 2, 3)).otherwise(bad.cast(kind))


def position(line: Column, col: Column) -> Column:
    """Line and column in one long that compares like them."""
    return line.cast("long") * (1 << 20) + col


#: Columns of a line, more than any has, where places are packed in one long.
PLACE_COLS = 1 << 31


def place(line: Column, col: Column) -> Column:
    """Line and column in one long, of which a hash aggregate can take the least; below 2 to the 62nd."""
    return line.cast("long") * PLACE_COLS + col
