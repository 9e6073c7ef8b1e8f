"""Languages: what differs between them when a source tree is indexed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .functions import text as fx
from .operators import call_edges
from .sources import files as fs


@dataclass(frozen=True)
class Adapter:
    """id names the projects of a language in a store; kinds of chunks that hold no code around what they import."""

    id: str
    language: str
    import_kinds: tuple[str, ...]

    @property
    def manifests(self) -> tuple[str, ...]:
        return fs.MANIFESTS[self.id]

    def source_files(self, listing: DataFrame, rules=()) -> DataFrame:
        return fs.source_files(listing, self.language, list(rules))

    def display_name(self, symbol: Column) -> Column:
        return fx.display_name(symbol, python=self.language == "python")

    def sites(self, files: DataFrame) -> DataFrame | None:
        """Calls and returns in the source text, for languages that have edges of them."""
        return call_edges.sites(files, self.language) if self.language in ("python", "typescript") else None


#: Kinds of import chunks by language.
ADAPTERS = {
    a.id: a
    for a in (
        Adapter("python-scip", "python", ("import_statement", "import_from_statement")), Adapter("typescript-scip", "typescript", ("import_statement",)),
        Adapter("go-scip", "go", ("import_declaration",)), Adapter("java-scip", "java", ("import_declaration",)), Adapter("rust-scip", "rust", ("use_declaration",)),
    )
}


def detected(listing: DataFrame, within: str = "") -> list[tuple[str, str, str]]:
    """(folder, adapter, manifest) of a tree's units, by folder and adapter. One row a unit."""
    found = [(r.dir, r.adapter_id, r.manifest) for r in fs.units(listing).collect()]
    if not found:
        raise LookupError("no unit of a known language is found")
    return sorted(u for u in found if u[0] == within or not within or u[0].startswith(within + "/"))
