"""Model artifacts as one table each: vocabulary, thresholds, allow-list, priors and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("labels", "thresholds", "allowed", "priors")


@dataclass
class Artifacts:
    """``thresholds`` holds one row per label and the global one with a null label."""

    labels: DataFrame
    thresholds: DataFrame
    allowed: DataFrame | None = None
    priors: DataFrame | None = None
    max_length: int = 256
    stride: int = 128
    top_k: int = 8
    category_prior_weight: float = 0.0

    def settings(self) -> dict:
        return {
            "max_length": self.max_length,
            "stride": self.stride,
            "top_k": self.top_k,
            "category_prior_weight": self.category_prior_weight,
        }


def threshold_table(per_label: DataFrame, overall: DataFrame) -> DataFrame:
    """Per-label rows plus the global row (null label)."""
    return per_label.select("label", "threshold").unionByName(
        overall.select(F.lit(None).cast("string").alias("label"), F.col("threshold"))
    )


def save_artifacts(a: Artifacts, path: str) -> None:
    for name in TABLES:
        table = getattr(a, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = a.labels.sparkSession
    row = a.settings()
    spark.createDataFrame([tuple(row.values())], "max_length int, stride int, top_k int, category_prior_weight double").write.mode(
        "overwrite"
    ).parquet(f"{path}/config")


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    """Read artifacts back; allow-list, priors and settings may be absent (defaults, prior weight 0)."""
    from pyspark.errors import AnalysisException

    def table(name: str, needed: bool) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if needed:
                raise
            return None

    config = table("config", False)
    settings = config.first().asDict() if config is not None else {}
    return Artifacts(
        table("labels", True), table("thresholds", True), table("allowed", False), table("priors", False), **settings
    )
