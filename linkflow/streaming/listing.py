"""The corpus listing as versions in shared storage, for streams.

A version holds each file name once, written before any batch reads it, so the
join of a batch with it has two plain sides and AQE can split a file that many
requests ask for. A batch takes the newest complete version: publishing another
one refreshes a running stream without a restart. The newest KEPT versions
stay, for batches that are under way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from linkflow.sources import storage

KEPT = 2
NAMES = "file_name STRING"


@dataclass
class Listing:
    folder: str

    def versions(self, spark: SparkSession) -> list[int]:
        """The complete versions, ascending."""
        return sorted(int(n) for n in storage.children(spark, self.folder)
                      if storage.exists(spark, f"{self.folder}/{n}/_SUCCESS"))

    def publish(self, names: DataFrame) -> int:
        """Writes a new version from ``names`` (column ``file_name``)."""
        spark = names.sparkSession
        old = self.versions(spark)
        new = old[-1] + 1 if old else 0
        names.select("file_name").where("file_name IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.folder}/{new}")
        for version in old[:-(KEPT - 1)]:
            storage.delete(spark, f"{self.folder}/{version}")
        return new

    def current(self, spark: SparkSession) -> DataFrame:
        """(file_name) of the newest complete version."""
        versions = self.versions(spark)
        if not versions:
            raise ValueError(f"no listing was published in {self.folder}")
        return spark.read.schema(NAMES).parquet(f"{self.folder}/{versions[-1]}")


def listing_of(names: DataFrame | Listing, folder: str) -> Listing:
    """``names`` as a listing: a table of names is published in ``folder``."""
    if isinstance(names, Listing):
        return names
    listing = Listing(folder)
    listing.publish(names)
    return listing
