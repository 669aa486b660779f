"""Connected components of small nodes by joins, and the lineage cut that its rounds need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir; where that is unset, in a temporary one if all runs on this machine, and else an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="formlens-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v); root is the least node that it is linked to, over any number of links.

    Each round takes the least root of a node's neighbours, and then the root's own root, so
    the rounds grow with the logarithm of the longest chain.
    """
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        offered = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("offer"))
        lower = roots.join(offered, "node").select("node", "root", F.least("root", "offer").alias("next"))
        ahead = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        moved = cut(lower.join(ahead, "next", "left").select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("moved")))
        roots = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return roots
