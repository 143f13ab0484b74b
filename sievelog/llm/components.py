"""Connected components of links between long ids, by alternating large and small stars; nothing meets on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, shared_folder


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id that links lead to.

    Each round replaces an id's links by links to its smallest neighbour, of which partial aggregation makes one row for
    each task; rounds grow with the logarithm of the longest path. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "links")
    links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().write.parquet(f"{folder}/0")
    edges, done, at = spark.read.parquet(f"{folder}/0"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        small.write.parquet(f"{folder}/{at + 1}")
        edges = spark.read.parquet(f"{folder}/{at + 1}")
        # a state is final when every id has one link, to an id that has none
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if at:
            remove(f"{folder}/{at}")
        if (state["n"], state["h"]) == done:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        done, at = (state["n"], state["h"]), at + 1
