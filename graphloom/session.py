"""Session helpers: sensible defaults, the shared scratch folder, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_TABLES: dict[str, list[str]] = {}


def build_session(app_name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session; a cluster's own settings win over these defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not start in its folder."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``. Only on a ``local`` master, where driver and
    executors are one process, a local folder is made where that setting is missing.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK_DIRS:
        _FALLBACK_DIRS[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _FALLBACK_DIRS[app]


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and return the table.

    With ``by`` it is bucketed by that column, so groupings, windows and joins on it need no shuffle.
    Rows should come dealt by ``dealt``, so that every task writes one bucket.

    This cuts the lineage of iterative jobs: a lost executor re-reads the table instead of
    replaying earlier rounds, nothing is computed twice, and the planner sees the real size
    (so small rounds become broadcast joins and large ones shuffle joins by themselves).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/graphloom-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"graphloom_{uuid.uuid4().hex}"
    df.write.bucketBy(parse_tasks(spark), by).option("path", path).format("parquet").saveAsTable(name)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows spread over ``parse_tasks`` by the hash that buckets of that column have."""
    return df.repartition(parse_tasks(df.sparkSession), by)


def parse_tasks(spark: SparkSession) -> int:
    """Tasks for work that is bound by CPU, not bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def clear_tables(spark: SparkSession) -> None:
    """Delete the written tables of this application; frames that read them end with it."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/graphloom-tables/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of frames with equal column names."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
