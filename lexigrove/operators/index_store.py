"""A vector index as tables: centroids, inverted lists in bytes, one row of parameters; built by stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.vector import dequantize, norm, quantize
from lexigrove.operators import vindex

#: Files of a list at most, so that no task writes a whole large list.
LIST_FILES = 8

STAGES = ("coarse", "fine", "add")


@dataclass(frozen=True)
class Index:
    """centroids: cluster_id, centroid. lists: vec_id, cluster_id, code. parameters: max_norm, offset, scale."""

    centroids: DataFrame
    lists: DataFrame
    max_norm: float
    offset: float
    scale: float

    def vectors(self) -> DataFrame:
        return self.lists.select("vec_id", "cluster_id", dequantize(F.col("code"), self.offset, self.scale).alias("embedding"))

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """Top k of the nprobe lists nearest to each query (qid, query); only these lists are read."""
        probes = vindex.probe(queries, self.centroids, nprobe)
        return vindex.probed_top_k(self.vectors(), probes, k)


def without(vectors: DataFrame, ignored: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors but those of ignored ids."""
    return vectors.join(ignored.select(key).distinct(), key, "left_anti")


def build(vectors: DataFrame, path: str, centroids: DataFrame | None = None, clusters: int = 16, most: float = 999.0, norm_factor: float = 1.0,
          offset: float = -2.0, scale: float = 20.0, stages: tuple[str, ...] = STAGES, ignored: DataFrame | None = None) -> None:
    """Make the stages named: coarse (centroids), fine (parameters of the bytes, largest norm), add (lists). Stages before must have been made.

    vectors: vec_id, embedding, and cluster_id where lists are given. Vectors beyond the norm most, or of ignored ids, are left out.
    """
    spark = vectors.sparkSession
    used = vindex.within_norm(vectors, most)
    if ignored is not None:
        used = without(used, ignored)
    if "coarse" in stages:
        (centroids if centroids is not None else vindex.train_centroids(used, clusters)).write.mode("overwrite").parquet(f"{path}/centroids")
    if "fine" in stages:
        row = used.agg((F.max(norm(F.col("embedding"))) * norm_factor).alias("max_norm"))
        row.select("max_norm", F.lit(offset).alias("offset"), F.lit(scale).alias("scale")).write.mode("overwrite").parquet(f"{path}/parameters")
    if "add" in stages:
        known = spark.read.parquet(f"{path}/parameters").first()
        listed = used if "cluster_id" in used.columns else vindex.assign(used, spark.read.parquet(f"{path}/centroids"))
        coded = listed.select("vec_id", quantize(F.col("embedding"), known["offset"], known["scale"]).alias("code"), "cluster_id")
        part = F.pmod(F.xxhash64("vec_id"), F.lit(LIST_FILES))
        coded.repartition("cluster_id", part).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/lists")


def load(spark: SparkSession, path: str, kind: str = "int") -> Index:
    """The index of a folder. kind: type of cluster_id."""
    row = spark.read.parquet(f"{path}/parameters").first()
    lists = spark.read.parquet(f"{path}/lists").withColumn("cluster_id", F.col("cluster_id").cast(kind))
    return Index(spark.read.parquet(f"{path}/centroids"), lists, row["max_norm"], row["offset"], row["scale"])
