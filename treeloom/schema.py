"""The two tables of a graph, and the words they use. All other tables are derived from these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = "id bigint, kind string, noun string, name string, parent bigint, ord bigint, path string, byte_start bigint, byte_end bigint, line_start int, line_end int, is_test boolean"
REFS = "ref_id bigint, src bigint, dst bigint, kind string, sites array<int>"
FILES = "file_id bigint, path string, text string"

ENTITY_KINDS = ("folder", "module", "file", "class", "function")
#: Strongest first: a pair that both calls and imports is a call.
REFERENCE_KINDS = ("call", "type_ref", "var_ref", "import", "generic")


def strength(kind: Column) -> Column:
    """Place of a reference kind among REFERENCE_KINDS; unknown kinds come last."""
    out = F.lit(len(REFERENCE_KINDS))
    for i, k in reversed(list(enumerate(REFERENCE_KINDS))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def ranged() -> Column:
    """Has this entity lines of its own? 0..0 says that it has none."""
    return ~((F.col("line_start") == 0) & (F.col("line_end") == 0))
