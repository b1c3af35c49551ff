"""Merkle fixity audit of WARC replicas (operator 1).

Every record of a replica is hashed; the records of a file, in offset order, are the leaves of a
tree whose inner nodes each hash an ordered offset range of ``FANOUT`` children. Two replicas are
compared by the roots of their files; only below nodes that differ the next level is looked at,
down to the records. There, records are matched by id: ``corrupt`` (other bytes), ``missing``,
``extra`` or ``moved`` (same bytes at another offset, after a lost or added record).

Trees are written once, one folder per level, so an audit reads the small upper levels and joins
only mismatching branches to the lower ones. A file is never one task: its leaves are numbered by
a window over (offset, length, hash) rows, the bytes stay behind in the scan.

Results: a file that only one replica has gives all its records as missing or extra. Null bodies
hash as empty. Replicas without files give no rows. Repeated record ids of a file are matched in
offset order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize, scratch_dir

FANOUT = 16
RECORDS_PER_FILE = 1000


def warc_records(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, record_id, body) of WARC response records for (page_id, url, html) rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">\r\nWARC-Target-URI: "), text("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"), text("html"), F.lit("\r\n\r\n"),
    )
    file = F.concat(F.lit("segment-"), F.lpad(F.expr(f"cast(coalesce(page_id, 0) div {records_per_file} as string)"), 9, "0"), F.lit(".warc"))
    return pages.select(file.alias("file"), F.col("page_id").alias("record_id"), body.alias("body"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, at, record_id, start, end, hash): records of a file in record order, with offsets.

    ``records`` has file, record_id and body, and offset if the place in the file is known;
    otherwise records follow each other by id. ``at`` counts from 0.
    """
    # Only hashes and lengths go through the shuffle.
    hashed = records.select(
        "file", "record_id", *(["offset"] if "offset" in records.columns else []),
        F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("length"), F.sha2(F.coalesce(F.col("body").cast("binary"), F.lit("").cast("binary")), 256).alias("hash"),
    )
    order = Window.partitionBy("file").orderBy(*(["offset"] if "offset" in records.columns else ["record_id"]), "hash")
    start = F.col("offset") if "offset" in records.columns else F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = hashed.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "start": start.cast("long")})
    return numbered.select("file", "at", "record_id", "start", (F.col("start") + F.col("length")).alias("end"), "hash")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first; a node is (file, at, start, end, hash)."""
    spark = records.sparkSession
    path = f"{scratch_dir(spark)}/merkle/{uuid.uuid4().hex}"
    leaves(records).write.parquet(f"{path}/level=0")
    levels = [spark.read.parquet(f"{path}/level=0")]
    last = levels[0].agg(F.max("at")).first()[0] or 0
    while last > 0:
        child = F.struct("at", "start", "end", "hash")
        bytes_of = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["start"], c["end"], c["hash"])), "\n")
        above = levels[-1].groupBy("file", F.floor(F.col("at") / FANOUT).alias("at")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(bytes_of, 256).alias("hash")
        )
        above.write.parquet(f"{path}/level={len(levels)}")
        levels.append(spark.read.parquet(f"{path}/level={len(levels)}"))
        last //= FANOUT
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(file, start, end, root) of every file."""
    return levels[-1].select("file", "start", "end", F.col("hash").alias("root"))


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes (file, at) that are not the same in both."""
    mine = ours.select("file", "at", F.struct("start", "end", "hash").alias("ours"))
    other = theirs.select("file", "at", F.struct("start", "end", "hash").alias("theirs"))
    return mine.join(other, ["file", "at"], "full").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "at")


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(file, record_id, kind, offset, length) of every record of ``replica`` that is not in
    ``primary`` as it stands there; offsets are those of the primary, of the replica for extras."""
    height = max(len(primary), len(replica))
    # A tree of fewer levels ends in its roots: they stand in for the missing upper levels.
    level = lambda tree, k: tree[min(k, len(tree) - 1)]
    suspects = materialize(_differing(level(primary, height - 1), level(replica, height - 1)))
    for k in range(height - 2, -1, -1):
        up = lambda tree: F.floor(F.col("at") / FANOUT) if k + 1 < len(tree) else F.lit(0).cast("long")  # noqa: B023, E731
        branch = lambda tree: (
            level(tree, k).withColumn("up", up(tree))  # noqa: B023
            .join(suspects.select("file", F.col("at").alias("up")), ["file", "up"], "left_semi")  # noqa: B023
        )
        suspects = materialize(_differing(branch(primary), branch(replica)))
    side = lambda tree, name: (
        tree[0].join(suspects, ["file", "at"], "left_semi")
        .withColumn("nth", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("start")))
        .select("file", "record_id", "nth", F.struct("start", "end", "hash").alias(name))
    )
    ours, theirs = side(primary, "ours"), side(replica, "theirs").withColumnsRenamed({"file": "f", "record_id": "r", "nth": "k"})
    both = ours.join(theirs, F.expr("file = f and record_id <=> r and nth = k"), "full")
    kind = (
        F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra")
        .when(F.col("ours.hash") != F.col("theirs.hash"), "corrupt").otherwise("moved")
    )
    at = F.coalesce("ours", "theirs")
    return both.select(
        F.coalesce("file", "f").alias("file"), F.coalesce("record_id", "r").alias("record_id"), kind.alias("kind"),
        at["start"].alias("offset"), (at["end"] - at["start"]).alias("length"),
    )


