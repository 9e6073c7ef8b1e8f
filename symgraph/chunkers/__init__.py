"""Chunkers: from source text to spans of declarations, table-valued, one file at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .braces import chunks as brace_chunks
from .braces import sites as brace_sites
from .python import chunks as python_chunks
from .python import sites as python_sites

SCHEMA = "file_path string, chunk_key string, kind string, name string, start_byte int, end_byte int, start_line int, start_col int, end_line int, end_col int, text string, header_text string"
__all__ = ["brace_sites", "chunk_files", "extract", "language_of", "python_sites"]
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".java": "java", ".rs": "rust"}


def language_of(path: str) -> str | None:
    return next((lang for end, lang in LANGUAGES.items() if path.lower().endswith(end)), None)


def extract(path: str, source: bytes) -> list[dict]:
    """Chunks of a file: the module, then declarations by start and, of equal ones, the later end."""
    language = language_of(path)
    spans = python_chunks(source) if language == "python" else brace_chunks(source, language) if language else []
    spans = [("module", path.rpartition("/")[2], 0, len(source)), *sorted(set(spans), key=lambda s: (s[2], -s[3]))]
    starts = [0]
    for k, b in enumerate(source):
        if b == 10:
            starts.append(k + 1)
    from bisect import bisect_right

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at) - 1
        return line, at - starts[line]

    out = []
    for kind, name, start, end in spans:
        text = source[start:end].decode("utf-8", "replace")
        (l0, c0), (l1, c1) = place(start), place(end)
        header = text.split("\n", 1)[0].strip()
        header = header.encode()[:160].decode("utf-8", "ignore")
        out.append({"file_path": path, "chunk_key": f"{path}:{start}:{end}:{kind}", "kind": kind, "name": name, "start_byte": start, "end_byte": end, "start_line": l0, "start_col": c0, "end_line": l1, "end_col": c1, "text": text, "header_text": header})
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """files: relative_path, content. Chunks of all files of known languages, in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column("relative_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if language_of(path):
                    yield from pa.Table.from_pylist(extract(path, bytes(data or b""))).cast(schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return files.select("relative_path", "content").mapInArrow(run, SCHEMA)
