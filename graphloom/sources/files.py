"""Python source files as rows.

Spark's own file sources skip names that start with ``_`` (and so every ``__init__.py``), hence
folders are listed here, one task row per folder and one round per folder level.
"""

from __future__ import annotations

import os
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.names import matches_any_glob
from graphloom.session import materialize, parse_tasks, union_all

# Contents are handed on in frames of about this size.
FLUSH_BYTES = 32 << 20
FILE_SCHEMA = "location string, is_dir boolean, modified double, size bigint"


def _list_folders(batches, suffix: str):
    from pyarrow import fs

    for batch in batches:
        rows = []
        for location in batch["location"]:
            system, path = fs.FileSystem.from_uri(location)
            for info in system.get_file_info(fs.FileSelector(path)):
                is_dir = info.type == fs.FileType.Directory
                if is_dir or info.path.endswith(suffix):
                    prefix = location.split("://")[0] + "://" if "://" in location else ""
                    rows.append((prefix + info.path, is_dir, info.mtime.timestamp() if info.mtime else None, info.size))
        yield pd.DataFrame(rows, columns=["location", "is_dir", "modified", "size"])


def _read_files(batches):
    from pyarrow import fs

    for batch in batches:
        contents: list[bytes | None] = []
        first = 0
        for location in batch["location"]:
            try:
                system, path = fs.FileSystem.from_uri(location)
                with system.open_input_stream(path) as stream:
                    contents.append(stream.read())
            except (FileNotFoundError, PermissionError):
                contents.append(None)  # any other error is raised, so that Spark tries again
            if sum(len(c or b"") for c in contents) >= FLUSH_BYTES:
                yield pd.DataFrame({"path": batch["path"][first : first + len(contents)], "content": contents})
                first, contents = first + len(contents), []
        yield pd.DataFrame({"path": batch["path"][first:], "content": contents})


def python_files(
    spark: SparkSession, root: str, exclude_patterns: list[str] | None = None, suffix: str = ".py"
) -> DataFrame:
    """Files under a folder (or a single file) that end in ``suffix``: (path, location, modified, size).

    A root that does not exist, also only as seen by an executor, is an error.

    Glob patterns are tested against the full path and the file name; for a single file they
    do not apply.
    """
    root = str(root)
    remote = "://" in root
    absolute = root if remote else os.path.abspath(root)
    if not remote and not os.path.exists(absolute):
        raise FileNotFoundError(absolute)
    if not remote and os.path.isfile(absolute):
        stat = os.stat(absolute)
        return spark.createDataFrame(
            [(os.path.normpath(root), absolute, stat.st_mtime, stat.st_size)] if absolute.endswith(suffix) else [],
            "path string, location string, modified double, size bigint",
        )
    folders = spark.range(1).select(F.lit(absolute).alias("location"))
    found = []
    while True:
        listed = materialize(folders.mapInPandas(partial(_list_folders, suffix=suffix), FILE_SCHEMA))
        found.append(listed.filter("not is_dir"))
        folders = listed.filter("is_dir").select("location").repartition("location")
        if listed.filter("is_dir").isEmpty():
            break
    shown = root if remote else os.path.normpath(root)
    prefix = "" if shown == "." else shown.rstrip("/") + "/"
    rest = F.substring("location", len(absolute.rstrip("/")) + 2, 2**31 - 1)
    files = union_all(found).select(F.concat(F.lit(prefix), rest).alias("path"), "location", "modified", "size")
    if exclude_patterns:
        files = files.filter(~matches_any_glob(F.col("path"), exclude_patterns))
    return files


def read_files(files: DataFrame) -> DataFrame:
    """Contents as (path, content); an unreadable file has null content."""
    tasks = parse_tasks(files.sparkSession)
    # The listing is dealt out; contents are read where they are used and never shuffled.
    return files.select("path", "location").repartition(tasks, "path").mapInPandas(_read_files, "path string, content binary")


def decoded(sources: DataFrame) -> DataFrame:
    """Contents as text (path, source); null where the bytes are not UTF-8."""
    return sources.select(
        "path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("source")
    )
