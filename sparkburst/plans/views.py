"""Parametrised views: the tables behind the pages of a results browser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogues


class Results:
    """Regions with their matches, as tables for pages."""

    def __init__(self, regions: DataFrame, matches: DataFrame):
        """``regions`` has cluster_label, ``matches`` region, cat_id, sep and segment-like type columns."""
        self.regions, self.matches = regions, matches

    def homepage(self) -> DataFrame:
        """One row of totals."""
        return self.regions.agg(
            F.count("*").alias("n_regions"), F.countDistinct("cluster_label").alias("n_unique"), F.countDistinct("obsid").alias("n_obs"), F.countDistinct("runid").alias("n_runs"), F.max("intensity").alias("max_intensity")
        )

    def region(self, cluster_label: int) -> dict[str, DataFrame]:
        out = catalogues.region_summary(self.regions, cluster_label)
        out["matches"] = self.matches.join(self.regions.where(F.col("cluster_label") == cluster_label).select("region"), "region", "left_semi")
        return out

    def observation(self, obsid: str) -> dict[str, DataFrame]:
        mine = self.regions.where(F.col("obsid") == obsid)
        return {"info": catalogues.observation_info(mine), "regions": mine.orderBy("runid", "label")}

    def object_type(self, otype: str) -> DataFrame:
        """Unique sources with a region of a type, the brightest first."""
        mine = self.regions.where(F.col("segment") == otype)
        return mine.groupBy("cluster_label").agg(F.count("*").alias("n_detections"), F.max("intensity").alias("max_intensity")).orderBy(F.desc("max_intensity"), "cluster_label")

    def flags(self, columns: list[str]) -> DataFrame:
        """Every raised flag of every region as a row."""
        on = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
        return self.regions.select("region", F.explode(on).alias("flag"))

    def neighbours(self) -> DataFrame:
        """Previous and next unique source, for paging; the ends have none."""
        labels = self.regions.select("cluster_label").distinct()
        before = labels.select((F.col("cluster_label") + 1).alias("cluster_label"), F.col("cluster_label").alias("previous"))
        after = labels.select((F.col("cluster_label") - 1).alias("cluster_label"), F.col("cluster_label").alias("next"))
        return labels.join(before, "cluster_label", "left").join(after, "cluster_label", "left")
