"""Name and multi-field search. Filters are plain predicates, limits are ordered top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _contains(field: str, text: str) -> Column:
    return F.contains(F.lower(F.col(field)), F.lit(text.lower()))


def search_by_name(entities: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """Case-insensitive equality, or substring when ``fuzzy``; wildcards have no meaning."""
    if fuzzy:
        return entities.filter(_contains("name", name))
    return entities.filter(F.lower("name") == name.lower())


def find_entities(
    entities: DataFrame,
    query: str,
    entity_type: str | None = None,
    file_path: str | None = None,
    fuzzy: bool = True,
    max_results: int | None = 10,
) -> DataFrame:
    """Name search plus type equality and case-sensitive path substring, first N by position."""
    found = search_by_name(entities, query, fuzzy)
    if entity_type is not None:
        found = found.filter(F.col("type") == entity_type)
    if file_path is not None:
        found = found.filter(F.contains(F.col("file_path"), F.lit(file_path)))
    return first_rows(found.select("ord", "id", "name", "type", "file_path", "line_number"), max_results)


def find_exact_or_fuzzy(entities: DataFrame, query: str, max_results: int = 10) -> DataFrame:
    """Exact matches if there are any, otherwise the substring matches (one pass, no collect)."""
    fuzzy = search_by_name(entities, query, fuzzy=True).withColumn(
        "exact", F.lower("name") == F.lit(query.lower())
    )
    any_exact = fuzzy.agg(F.coalesce(F.bool_or("exact"), F.lit(False))).scalar()
    return first_rows(
        fuzzy.filter(F.col("exact") | ~any_exact).select("ord", "id", "name", "type", "file_path", "line_number", "exact"),
        max_results,
    )


# JSON key that holds an entity's description.
DESCRIPTION_PATH = "$.description"


def search_fields(
    entities: DataFrame,
    query: str,
    fields: tuple[str, ...] = ("name", "id", "file_path", "description"),
    entity_type: str | None = None,
    max_results: int | None = 100,
) -> DataFrame:
    """Substring search over several fields at once (viewer, IDE and picker search boxes)."""
    hit = F.lit(False)
    for field in fields:
        if field == "description":
            text = F.get_json_object("properties", DESCRIPTION_PATH)
            hit = hit | F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))
        else:
            hit = hit | F.coalesce(_contains(field, query), F.lit(False))
    found = entities.filter(hit)
    if entity_type is not None:
        found = found.filter(F.col("type") == entity_type)
    return first_rows(found.select("ord", "id", "name", "type", "file_path", "line_number"), max_results)


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    """Point lookup: where to jump for a definition."""
    return entities.filter(F.col("id") == entity_id)


def entities_by_file(entities: DataFrame, file_path: str) -> DataFrame:
    return entities.filter(F.col("file_path") == file_path)


def entities_by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.filter(F.col("type") == entity_type)


def all_file_paths(entities: DataFrame) -> DataFrame:
    return entities.select("file_path").distinct()


def entity_options(entities: DataFrame) -> DataFrame:
    """Choice list ``name (type)`` in label order."""
    label = F.concat("name", F.lit(" ("), "type", F.lit(")"))
    return entities.select("id", label.alias("label"), "type").orderBy(F.lower("label"), "label", "id")


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ``ord`` (``TakeOrderedAndProject``: top-k per task, then merged)."""
    if limit is None:
        return df
    return df.orderBy("ord", "id").limit(limit)
