"""Table layouts and the closed lists of entity and relationship types."""

from __future__ import annotations

from pyspark.sql import types as T

# The type names of the data model and of its JSON interchange format.
ENTITY_TYPES = (
    "FILE", "MODULE", "CLASS", "FUNCTION", "ASYNC_FUNCTION", "CONSTANT", "VARIABLE",
    "IMPORT", "DIRECTORY", "DECORATOR", "EXCEPTION", "EXTERNAL_REF",
)
RELATIONSHIP_TYPES = (
    "CONTAINS", "DEFINES_IN", "CALLS", "IMPORTS", "INHERITS", "INSTANTIATES", "USES",
    "LOCATED_IN", "IMPORTS_RESOLVED_TO", "CALLS_RESOLVED", "DEFINES_SYMBOL",
)
# Types the IDE's counter shows even at zero.
COUNTED_TYPES = (
    "FILE", "MODULE", "CLASS", "FUNCTION", "ASYNC_FUNCTION", "CONSTANT", "VARIABLE",
    "IMPORT", "DECORATOR",
)
# What the viewer can display; anything else falls back to the last argument
# of the corresponding function in operators.subgraph.
VIEWER_ENTITY_TYPES = ("FILE", "MODULE", "CLASS", "FUNCTION", "VARIABLE", "CONSTANT", "IMPORT", "DECORATOR")
VIEWER_RELATIONSHIP_TYPES = RELATIONSHIP_TYPES

ENTITY_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("properties", T.StringType()),
])

RELATIONSHIP_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("is_resolved", T.BooleanType()),
    T.StructField("properties", T.StringType()),
])

ENTITY_COLUMNS = ENTITY_SCHEMA.names
RELATIONSHIP_COLUMNS = RELATIONSHIP_SCHEMA.names


def check_relationship_types(names) -> list[str]:
    """Validate relationship type names; an unknown one is a ``KeyError``."""
    wanted = list(names)
    for name in wanted:
        if name not in RELATIONSHIP_TYPES:
            raise KeyError(name)
    return wanted
