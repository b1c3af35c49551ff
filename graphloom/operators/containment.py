"""Containment closure and the tree views built on ids and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.names import SEPARATOR, ancestor_ids, base_name, directory

# Display rank of entity types inside a file; other types rank last.
TYPE_RANK = {"CLASS": 1, "FUNCTION": 2, "ASYNC_FUNCTION": 3, "CONSTANT": 4, "VARIABLE": 5, "IMPORT": 6}
OTHER_RANK = 9
# Rows that stand for a file itself and are hidden from tree views.
FILE_LIKE = ("FILE", "MODULE")


def containment_edges(entities: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One CONTAINS edge from every ``::`` prefix of an id to the entity (not only its parent).

    ``ord`` is the entity's position, ``level`` the prefix length. Repeated definitions of one id
    produce repeated edges. A pure explode: no shuffle.
    """
    return (
        entities.filter(F.col("id").contains(SEPARATOR) & ~F.col("type").isin("FILE", "MODULE"))
        .select("ord", "id", "line_number", *keep, F.posexplode(ancestor_ids(F.col("id"))).alias("pos", "source_id"))
        .select(
            "ord",
            (F.col("pos") + 1).alias("level"),
            "source_id",
            F.col("id").alias("target_id"),
            F.lit("CONTAINS").alias("type"),
            "line_number",
            *keep,
        )
    )


def _leaf_files(entities: DataFrame) -> DataFrame:
    return entities.filter(~F.col("type").isin(*FILE_LIKE))


def tree_roots(entities: DataFrame) -> DataFrame:
    """Folders that hold entities (with their number of files) and files without a folder."""
    files = _leaf_files(entities).select("file_path").distinct()
    folder = directory(F.col("file_path"))
    folders = (
        files.filter(folder != "")
        .groupBy(folder.alias("path"))
        .agg(F.count(F.lit(1)).alias("files"))
        .select(F.lit("directory").alias("kind"), "path", base_name(F.col("path")).alias("label"), "files")
    )
    loose = files.filter(~F.col("file_path").contains("/")).select(
        F.lit("file").alias("kind"),
        F.col("file_path").alias("path"),
        F.col("file_path").alias("label"),
        F.lit(1).cast("long").alias("files"),
    )
    return folders.unionByName(loose)


def files_in_directory(entities: DataFrame, folder: str) -> DataFrame:
    """Distinct file names anywhere below ``folder``; nested ones are shown flat under it."""
    return (
        _leaf_files(entities)
        .filter(F.col("file_path").startswith(folder + "/"))
        .select(base_name(F.col("file_path")).alias("file_name"))
        .filter(F.col("file_name") != "")
        .distinct()
        .withColumn("path", F.concat(F.lit(folder + "/"), "file_name"))
    )


def type_rank(type_col):
    rank = F.lit(OTHER_RANK)
    for name, value in TYPE_RANK.items():
        rank = F.when(type_col == name, value).otherwise(rank)
    return rank


def entities_in_file(entities: DataFrame, file_path: str) -> DataFrame:
    """Entities of one file, classes first, then functions and so on, by line within a type."""
    return (
        entities.filter(F.col("file_path") == file_path)
        .withColumn("type_rank", type_rank(F.col("type")))
        .orderBy("type_rank", "line_number", "ord")
    )


def descendants(entities: DataFrame, parent_id: str) -> DataFrame:
    """Everything below an id. The prefix test reaches the Parquet scan as ``StringStartsWith``."""
    return entities.filter(F.col("id").startswith(parent_id + SEPARATOR))
