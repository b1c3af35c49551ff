"""Substring search through a stored trigram index.

Every position of a lower-case field value starts one gram of three characters (the value's end is
padded, so shorter texts have grams too). Three tables are written once: ``rows``, the entities in the
order of their positions, dealt into ``parts`` folders and there into blocks; ``postings`` (field, gram,
block) in the order of field and gram, so that a lookup reads only the row groups of its grams; ``grams``
with the number of blocks of each. A gram is posted once a block, however many rows of it hold it, and
is merged before the shuffle, so an index moves far fewer postings than there are characters. A search
intersects the postings of the rarest grams of its text, opens only the folders that hold candidates and
tests the real field values in the blocks found, so its answer is that of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from graphloom.operators.search import DESCRIPTION_PATH, first_rows
from graphloom.schema import ENTITY_COLUMNS, ENTITY_SCHEMA

GRAM = 3
#: Postings that are intersected; rarer grams leave fewer candidates, and verification decides.
INTERSECTED = 3
PARTS = 64
#: A block is 2**``BLOCK_BITS`` rows of a folder, and a folder's blocks share the bits from ``PART_BITS`` on.
BLOCK_BITS = 12
PART_BITS = 33 - BLOCK_BITS
ROW_SCHEMA = T.StructType([*ENTITY_SCHEMA, T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType())])
PAD = "\0" * (GRAM - 1)


def field_value(field: str) -> Column:
    value = F.get_json_object("properties", DESCRIPTION_PATH) if field == "description" else F.col(field)
    return F.lower(F.coalesce(value, F.lit("")))


def grams_of(text: str) -> list[str]:
    """The grams a value must have to contain ``text``; for shorter texts there is only a prefix."""
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))


def part_of(block: Column) -> Column:
    return F.shiftright(block, PART_BITS).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """The stored index in ``folder``."""

    spark: SparkSession
    folder: str
    parts: int = PARTS

    @classmethod
    def build(cls, entities: DataFrame, folder: str, fields: tuple[str, ...] = ("name",), parts: int = PARTS) -> "TextIndex":
        """Write the index of ``fields``."""
        spark = entities.sparkSession
        index = cls(spark, folder, parts)
        rows = entities.select(*ENTITY_COLUMNS).repartitionByRange(parts, "ord", "id").sortWithinPartitions("ord", "id")
        # A row's number holds its partition and its place there.
        rows = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
        rows.withColumn("part", part_of(F.col("block"))).write.partitionBy("part").parquet(f"{folder}/rows")
        values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), field_value(f).alias("value")) for f in fields])).alias("v")
        padded = F.concat("v.value", F.lit(PAD))
        starts = F.sequence(F.lit(1), F.length("v.value"))
        grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM)))
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        postings = (
            index.rows.select("block", values).filter("v.value <> ''").select("block", "v.field", F.explode(grams).alias("gram"))
            .distinct().repartitionByRange(spread, "field", "gram", "block").sortWithinPartitions("field", "gram", "block")
        )
        postings.write.parquet(f"{folder}/postings")
        index.postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(
            min(spread, 16), "field", "gram").sortWithinPartitions("field", "gram").write.parquet(f"{folder}/grams")
        return index

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("block bigint, field string, gram string").parquet(f"{self.folder}/postings")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW_SCHEMA).parquet(f"{self.folder}/rows")

    def rarest(self, field: str, text: str) -> list[str] | None:
        """The rarest grams of ``text``, rarest first; None if one does not occur at all."""
        wanted = grams_of(text)
        found = {
            r.gram: r.n for r in self.spark.read.schema("field string, gram string, n bigint").parquet(f"{self.folder}/grams")
            .filter((F.col("field") == field) & F.col("gram").isin(wanted)).collect()
        }
        if len(found) < len(wanted):
            return None
        return sorted(wanted, key=lambda g: (found[g], g))[:INTERSECTED]

    def candidates(self, field: str, text: str) -> DataFrame:
        """Blocks with entities whose ``field`` may contain the lower-case ``text``."""
        postings = self.postings.filter(F.col("field") == field)
        if len(text) < GRAM:
            return postings.filter(F.col("gram").startswith(text)).select("block").distinct()
        rarest = self.rarest(field, text)
        if rarest is None:
            return postings.limit(0).select("block")
        found = postings.filter(F.col("gram") == rarest[0]).select("block")
        for gram in rarest[1:]:
            found = found.join(postings.filter(F.col("gram") == gram).select("block"), "block", "left_semi")
        return found

    def search(
        self, query: str, fields: tuple[str, ...] = ("name",), entity_type: str | None = None,
        file_path: str | None = None, max_results: int | None = 10,
    ) -> DataFrame:
        """What ``find_entities`` or ``search_fields`` finds: substring of any of ``fields``."""
        text = query.lower()
        if not text:
            rows = self.rows
        else:
            found = self.candidates(fields[0], text)
            for field in fields[1:]:
                found = found.unionByName(self.candidates(field, text))
            found = found.distinct()
            # At most ``parts`` numbers: the folders that hold a candidate.
            parts = [r.part for r in found.select(part_of(F.col("block")).alias("part")).distinct().collect()]
            hit = F.lit(False)
            for field in fields:
                hit = hit | F.contains(field_value(field), F.lit(text))
            rows = self.rows.filter(F.col("part").isin(parts)).join(found, "block", "left_semi").filter(hit)
        if entity_type is not None:
            rows = rows.filter(F.col("type") == entity_type)
        if file_path is not None:
            rows = rows.filter(F.contains(F.col("file_path"), F.lit(file_path)))
        return first_rows(rows.select("ord", "id", "name", "type", "file_path", "line_number"), max_results)
