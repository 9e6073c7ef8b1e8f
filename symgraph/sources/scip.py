"""Symbol indexes in SCIP's protobuf form, read as nested rows and flattened into the model's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx

SYMBOL = "struct<symbol:string,documentation:array<string>,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>,kind:int,display_name:string,signature:string,enclosing_symbol:string>"
OCCURRENCE = "struct<range:array<int>,symbol:string,symbol_roles:int,syntax_kind:int,enclosing_range:array<int>>"
DOCUMENT = f"artifact string, doc_ord int, is_external boolean, language string, relative_path string, text string, symbols array<{SYMBOL}>, occurrences array<{OCCURRENCE}>"

#: Names of symbol and syntax kinds by number.
SYMBOL_KINDS = {
    1: "Array", 2: "Assertion", 3: "AssociatedType", 4: "Attribute", 5: "Axiom", 6: "Boolean", 7: "Class", 8: "Constant", 9: "Constructor",
    10: "DataFamily", 11: "Enum", 12: "EnumMember", 13: "Event", 14: "Fact", 15: "Field", 16: "File", 17: "Function", 18: "Getter", 19: "Grammar",
    20: "Instance", 21: "Interface", 22: "Key", 23: "Lang", 24: "Lemma", 25: "Macro", 26: "Method", 27: "MethodReceiver", 28: "Message", 29: "Module",
    30: "Namespace", 31: "Null", 32: "Number", 33: "Object", 34: "Operator", 35: "Package", 36: "PackageObject", 37: "Parameter", 38: "ParameterLabel",
    39: "Pattern", 40: "Predicate", 41: "Property", 42: "Protocol", 43: "Quasiquoter", 44: "SelfParameter", 45: "Setter", 46: "Signature", 47: "Subscript",
    48: "String", 49: "Struct", 50: "Tactic", 51: "Theorem", 52: "ThisParameter", 53: "Trait", 54: "Type", 55: "TypeAlias", 56: "TypeClass",
    57: "TypeFamily", 58: "TypeParameter", 59: "Union", 60: "Value", 61: "Variable", 62: "Contract", 63: "Error", 64: "Library", 65: "Modifier",
    66: "AbstractMethod", 67: "MethodSpecification", 68: "ProtocolMethod", 69: "PureVirtualMethod", 70: "TraitMethod", 71: "TypeClassMethod",
    72: "Accessor", 73: "Delegate", 74: "MethodAlias", 75: "SingletonClass", 76: "SingletonMethod", 77: "StaticDataMember", 78: "StaticEvent",
    79: "StaticField", 80: "StaticMethod", 81: "StaticProperty", 82: "StaticVariable", 84: "Extension", 85: "Mixin", 86: "Concept",
}
SYNTAX_KINDS = {
    1: "Comment", 2: "PunctuationDelimiter", 3: "PunctuationBracket", 4: "Keyword", 5: "IdentifierOperator", 6: "Identifier", 7: "IdentifierBuiltin",
    8: "IdentifierNull", 9: "IdentifierConstant", 10: "IdentifierMutableGlobal", 11: "IdentifierParameter", 12: "IdentifierLocal", 13: "IdentifierShadowed",
    14: "IdentifierNamespace", 15: "IdentifierFunction", 16: "IdentifierFunctionDefinition", 17: "IdentifierMacro", 18: "IdentifierMacroDefinition",
    19: "IdentifierType", 20: "IdentifierBuiltinType", 21: "IdentifierAttribute", 22: "RegexEscape", 23: "RegexRepeated", 24: "RegexWildcard",
    25: "RegexDelimiter", 26: "RegexJoin", 27: "StringLiteral", 28: "StringLiteralEscape", 29: "StringLiteralSpecial", 30: "StringLiteralKey",
    31: "CharacterLiteral", 32: "NumericLiteral", 33: "BooleanLiteral", 34: "Tag", 35: "TagAttribute", 36: "TagDelimiter",
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in wire format: numbers, or bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} isn't in use")
        yield number, value


def _ints(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _relationship(data: bytes) -> dict:
    out = {"symbol": "", "is_reference": False, "is_implementation": False, "is_type_definition": False, "is_definition": False}
    names = {2: "is_reference", 3: "is_implementation", 4: "is_type_definition", 5: "is_definition"}
    for n, v in fields(data):
        if n == 1:
            out["symbol"] = v.decode()
        elif n in names:
            out[names[n]] = bool(v)
    return out


def _symbol(data: bytes) -> dict:
    out = {"symbol": "", "documentation": [], "relationships": [], "kind": 0, "display_name": "", "signature": "", "enclosing_symbol": ""}
    for n, v in fields(data):
        if n == 1:
            out["symbol"] = v.decode()
        elif n == 3:
            out["documentation"].append(v.decode())
        elif n == 4:
            out["relationships"].append(_relationship(v))
        elif n == 5:
            out["kind"] = v
        elif n == 6:
            out["display_name"] = v.decode()
        elif n == 7:
            out["signature"] = next((x.decode() for m, x in fields(v) if m == 5), "")
        elif n == 8:
            out["enclosing_symbol"] = v.decode()
    return out


def _occurrence(data: bytes) -> dict:
    out = {"range": [], "symbol": "", "symbol_roles": 0, "syntax_kind": 0, "enclosing_range": []}
    for n, v in fields(data):
        if n == 1:
            out["range"] += _ints(v)
        elif n == 2:
            out["symbol"] = v.decode()
        elif n == 3:
            out["symbol_roles"] = v
        elif n == 5:
            out["syntax_kind"] = v
        elif n == 7:
            out["enclosing_range"] += _ints(v)
    return out


def decode(data: bytes) -> Iterator[dict]:
    """A row a document, and one for the external symbols."""
    external, nr = [], 0
    for n, v in fields(data):
        if n == 2:
            doc = {"doc_ord": nr, "is_external": False, "language": "", "relative_path": "", "text": "", "symbols": [], "occurrences": []}
            names = {1: "relative_path", 4: "language", 5: "text"}
            for m, x in fields(v):
                if m == 2:
                    doc["occurrences"].append(_occurrence(x))
                elif m == 3:
                    doc["symbols"].append(_symbol(x))
                elif m in names:
                    doc[names[m]] = x.decode()
            nr += 1
            yield doc
        elif n == 3:
            external.append(_symbol(v))
    if external:
        yield {"doc_ord": -1, "is_external": True, "language": "", "relative_path": "", "text": "", "symbols": external, "occurrences": []}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all index files at a path. Decoding is per file, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = to_arrow_schema(_parse_datatype_string(DOCUMENT))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [{"artifact": name} | d for d in decode(data)]
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.mapInArrow(run, DOCUMENT)


def _kind(number: Column, names: dict[int, str]) -> Column:
    """The snake_case name of a kind, by a map of constants."""
    pairs = [x for n, name in names.items() for x in (F.lit(n), F.lit(name))]
    return F.coalesce(fx.enum_label(F.element_at(F.create_map(*pairs), number)), F.lit(""))


def symbols(docs: DataFrame, shown: Callable[[Column], Column] = fx.display_name) -> DataFrame:
    """Symbol records: externals first, then documents in order, the last one of a symbol holds."""
    rows = docs.select("artifact", "doc_ord", "relative_path", F.posexplode("symbols").alias("nr", "s")).where("s.symbol <> ''")
    w = Window.partitionBy("artifact", "s.symbol").orderBy(F.desc("doc_ord"), F.desc("nr"))
    rows = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    name = fx.first_non_empty(F.col("s.display_name"), shown(F.col("s.symbol")))
    return rows.select(
        F.col("s.symbol").alias("scip_symbol"), name.alias("display_name"), fx.first_non_empty(_kind(F.col("s.kind"), SYMBOL_KINDS), F.lit("symbol")).alias("kind"),
        F.col("relative_path").alias("file_path"), F.col("s.signature").alias("signature"), fx.doc_summary(F.col("s.documentation")).alias("doc_summary"),
        F.col("s.enclosing_symbol").alias("enclosing_symbol"),
    )


def relationship_edges(docs: DataFrame) -> DataFrame:
    """Edges of symbols' relationships, one for each flag, each once."""
    rows = docs.select(F.explode("symbols").alias("s")).select(F.col("s.symbol").alias("src_symbol"), F.explode("s.relationships").alias("r"))
    kinds = {"reference": "is_reference", "implementation": "is_implementation", "type_definition": "is_type_definition", "definition": "is_definition"}
    flags = F.array_compact(F.array(*(F.when(F.col(f"r.{flag}"), kind) for kind, flag in kinds.items())))
    rows = rows.select("src_symbol", F.col("r.symbol").alias("dst_symbol"), F.explode(flags).alias("kind"), F.lit("scip").alias("provenance"))
    return rows.where("src_symbol <> '' AND dst_symbol <> ''").distinct()


def occurrences(docs: DataFrame) -> DataFrame:
    """Occurrences with ranges, the enclosing one defaulting to their own, and role flags."""
    rows = docs.select(F.col("relative_path").alias("file_path"), "doc_ord", F.posexplode("occurrences").alias("occ_ord", "o"))
    rows = rows.withColumn("r", sx.decoded_range(F.col("o.range")))
    has = F.size("o.enclosing_range").isin(3, 4)
    rows = rows.withColumn("e", F.when(has, sx.decoded_range(F.when(has, F.col("o.enclosing_range")).otherwise(F.col("o.range")))).otherwise(F.col("r")))
    bits = F.col("o.symbol_roles")
    flags = {"is_definition": sx.DEFINITION, "is_import": sx.IMPORT, "is_write": sx.WRITE, "is_read": sx.READ}
    return rows.select(
        "file_path", "doc_ord", "occ_ord", F.col("o.symbol").alias("symbol"), "r.start_line", "r.start_col", "r.end_line", "r.end_col",
        F.col("e.start_line").alias("enclosing_start_line"), F.col("e.start_col").alias("enclosing_start_col"), F.col("e.end_line").alias("enclosing_end_line"), F.col("e.end_col").alias("enclosing_end_col"),
        bits.alias("role_bits"), fx.first_non_empty(_kind(F.col("o.syntax_kind"), SYNTAX_KINDS), F.lit("reference")).alias("syntax_kind"), *(sx.has_bit(bits, b).alias(n) for n, b in flags.items()),
    )


def contains_edges(docs: DataFrame) -> DataFrame:
    """From the symbol that a symbol's record says it stands in."""
    rows = docs.where("NOT is_external").select(F.explode("symbols").alias("s")).where("s.enclosing_symbol <> '' AND s.symbol <> ''")
    return rows.select(F.col("s.enclosing_symbol").alias("src_symbol"), F.col("s.symbol").alias("dst_symbol"), F.lit("contains").alias("kind"), F.lit("scip").alias("provenance")).distinct()


def located(found: DataFrame, occ: DataFrame, shown: Callable[[Column], Column] = fx.display_name) -> DataFrame:
    """symbols with the place of their last definition, its enclosing range, and records for symbols that only
    occur. A symbol is of the file that defines it last."""
    place = F.struct("file_path", *(F.col(f"enclosing_{c}").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")))
    order = F.when(F.col("is_definition"), F.struct("doc_ord", "occ_ord"))
    places = occ.where("symbol <> ''").groupBy("symbol").agg(F.max_by(place, order).alias("d"))
    both = found.join(places, F.col("scip_symbol") == F.col("symbol"), "full_outer")
    symbol = F.coalesce("scip_symbol", "symbol")
    return both.select(
        symbol.alias("scip_symbol"), F.coalesce("display_name", shown(F.col("symbol"))).alias("display_name"), F.coalesce("kind", F.lit("symbol")).alias("kind"),
        F.coalesce("d.file_path", found["file_path"], F.lit("")).alias("file_path"), F.col("d.start_line").alias("def_start_line"), F.col("d.start_col").alias("def_start_col"),
        F.col("d.end_line").alias("def_end_line"), F.col("d.end_col").alias("def_end_col"), F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce("doc_summary", F.lit("")).alias("doc_summary"), F.coalesce("enclosing_symbol", F.lit("")).alias("enclosing_symbol"),
    )
