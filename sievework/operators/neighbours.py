"""Names within a small edit distance, through a stored index of what is left of them when bytes are deleted.

Two names within ``distance`` edits have a common rest when at most that many bytes are deleted from the first ``PREFIX`` bytes of each. The index has a row for
each such rest of each name, keyed by a hash of the rest and the name's length; a query looks up the rests of what is wanted at the lengths that can be, and verifies the
few names found by their byte distance. No query scans the names, and hashes that meet by chance are sorted out by the distance.

Defined results: distances are over UTF-8 bytes, as in ``names.suggest``; the empty name and null are no names; repeated names count once; ties go to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import byte_distance
from ..session import new_path

PREFIX = 10


def _shorter(x: Column) -> Column:
    """All texts with one character less."""
    drop = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.when(F.length(x) > 0, drop).otherwise(F.array().cast("array<string>"))


def rests(name: Column, distance: int) -> Column:
    """What can be left of the name's first bytes when up to ``distance`` are deleted; bytes are taken as characters of a one-byte charset."""
    front = F.substring(F.decode(F.encode(name, "utf-8"), "iso-8859-1"), 1, PREFIX)
    out = last = F.array(front)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _shorter)))
        out = F.array_union(out, last)
    return out


class NeighbourIndex:
    """A stored index of distinct names for one distance."""

    def __init__(self, spark: SparkSession, folder: str, distance: int = 2):
        self.spark, self.folder, self.distance = spark, folder, distance
        self.rows = spark.read.schema("key long, name string").parquet(f"{folder}/rests")

    @classmethod
    def build(cls, names: DataFrame, name_col: str, distance: int = 2, folder: str | None = None) -> NeighbourIndex:
        """Index the names; without ``folder`` in the shared one."""
        if not 0 <= distance <= 3:
            raise ValueError("the distance is 0 to 3")
        folder = folder or new_path(names.sparkSession, "neighbours")
        one = names.select(F.col(name_col).alias("name")).where("name <> ''").distinct()
        rest = one.select("name", F.explode(rests(F.col("name"), distance)).alias("rest"))
        made = rest.select(F.xxhash64("rest", F.octet_length("name")).alias("key"), "name")
        made.sortWithinPartitions("key").write.parquet(f"{folder}/rests")
        return cls(names.sparkSession, folder, distance)

    def near(self, wanted: DataFrame, wanted_col: str) -> DataFrame:
        """(wanted, name, distance) of all pairs within the distance."""
        d = self.distance
        asked = wanted.select(F.col(wanted_col).alias("wanted")).where("wanted <> ''").distinct()
        lengths = F.sequence(F.octet_length("wanted") - d, F.octet_length("wanted") + d)
        probes = asked.select("wanted", F.explode(rests(F.col("wanted"), d)).alias("rest")).select("wanted", "rest", F.explode(lengths).alias("n"))
        probes = probes.select("wanted", F.xxhash64("rest", F.col("n").cast("int")).alias("key"))
        found = probes.join(self.rows, "key").select("wanted", "name").distinct()
        return found.withColumn("distance", byte_distance(F.col("wanted"), F.col("name"), d)).where("distance >= 0")

    def suggest(self, wanted: DataFrame, wanted_col: str, top: int = 3) -> DataFrame:
        """(wanted, name, distance, rank) of the ``top`` nearest names for each."""
        order = W.partitionBy("wanted").orderBy("distance", "name")
        return self.near(wanted, wanted_col).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def suggest_one(self, wanted: str, top: int = 3) -> DataFrame:
        """(name, distance) for one name: only the pages of the index that hold its keys are read."""
        one = self.spark.createDataFrame([(wanted,)], "wanted string")
        n, d = len(wanted.encode()), self.distance
        keys = one.select(F.explode(rests(F.col("wanted"), d)).alias("rest")).select(F.explode(F.array(*[F.xxhash64("rest", F.lit(k)) for k in range(max(n - d, 0), n + d + 1)])).alias("key"))
        some = self.rows.where(F.col("key").isin([r.key for r in keys.distinct().collect()]))  # a bounded number: rests of PREFIX bytes
        near = some.select("name").distinct().withColumn("distance", byte_distance(F.col("name"), F.lit(wanted), d))
        return near.where("distance >= 0").orderBy("distance", "name").limit(top)
