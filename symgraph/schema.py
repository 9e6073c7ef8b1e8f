"""Schemas of the model's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(text: str) -> T.StructType:
    kinds = {"s": _S, "i": _I, "l": _L, "d": _D, "b": _B, "t": T.TimestampType(), "v": T.ArrayType(T.FloatType(), True)}
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in (x.split(":") for x in text.split())])


#: By table; every row carries the project it belongs to as (root_path, adapter_id).
TABLES = {
    "projects": _struct("root_path:s name:s language:s manifest_path:s environment_source:s adapter_id:s scip_artifact_path:s tool_name:s tool_version:s last_indexed_at:t git_commit_hash:s"),
    "files": _struct("root_path:s adapter_id:s relative_path:s abs_path:s language:s content_hash:s line_count:i"),
    "symbols": _struct("root_path:s adapter_id:s scip_symbol:s display_name:s kind:s file_path:s def_start_line:i def_start_col:i def_end_line:i def_end_col:i signature:s doc_summary:s enclosing_symbol:s"),
    "occurrences": _struct("root_path:s adapter_id:s file_path:s symbol:s start_line:i start_col:i end_line:i end_col:i enclosing_start_line:i enclosing_start_col:i enclosing_end_line:i enclosing_end_col:i role_bits:i syntax_kind:s is_definition:b is_import:b is_read:b is_write:b"),
    "chunks": _struct("root_path:s adapter_id:s chunk_key:s file_path:s kind:s name:s parent_key:s start_byte:i end_byte:i start_line:i start_col:i end_line:i end_col:i text:s header_text:s retrieval_text:s primary_symbol:s"),
    "chunk_symbols": _struct("root_path:s adapter_id:s chunk_key:s symbol:s role:s weight:d"),
    "edges": _struct("root_path:s adapter_id:s src_symbol:s dst_symbol:s kind:s provenance:s"),
    "embeddings": _struct("root_path:s adapter_id:s owner_type:s owner_key:s model:s text_hash:s text:s vector:v"),
    "index_runs": _struct("root_path:s adapter_id:s started_at:t completed_at:t status:s files_indexed:l symbols_indexed:l chunks_indexed:l error_text:s"),
}

#: Natural keys of the tables.
KEYS = {
    "projects": ("root_path", "adapter_id"),
    "files": ("root_path", "adapter_id", "relative_path"),
    "symbols": ("root_path", "adapter_id", "scip_symbol"),
    "chunks": ("root_path", "adapter_id", "chunk_key"),
    "chunk_symbols": ("root_path", "adapter_id", "chunk_key", "symbol", "role"),
    "edges": ("root_path", "adapter_id", "src_symbol", "dst_symbol", "kind", "provenance"),
    "embeddings": ("root_path", "adapter_id", "owner_type", "owner_key"),
}
DIMENSION = 384
