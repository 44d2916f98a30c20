"""Connected components of claims, and what follows from them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Names the shared folder for what is saved; only a local session may use a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="plotwise-"))


def saved(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that edges lead to.  Labels spread along edges and then jump to their own label."""
    both = saved(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x is not null and y is not null").distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels, mark = saved(labels), None
    while True:
        # A label is never above its node, so that this is the node, but dealt out anew: a hub's edges can then be split.
        spread = labels.select(F.greatest("node", "component").alias("node"), "component")
        told = both.join(spread, both.y == spread.node).groupBy("x").agg(F.min("component").alias("heard"))
        near = labels.join(told, labels.node == told.x).select("node", F.least("component", "heard").alias("component"))
        further = near.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        labels = saved(near.join(further, "component", "left").select("node", F.coalesce(F.least("component", "jump"), "component").alias("component")))
        now = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if now == mark:
            return labels
        mark = now


def updated(labels: DataFrame, edges: DataFrame, changed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components of ``edges``, from the labels of the edges before and those of them that were added or retracted.

    Only components that a changed edge touches are computed again.  A node without an edge has no component.
    """
    ends = changed.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    touched = labels.join(ends, "node").select("component").distinct()
    nodes = saved(labels.join(touched, "component", "left_semi").select("node").union(ends).distinct())
    again = edges.join(nodes.withColumnRenamed("node", a), a, "left_semi").select(a, b).union(edges.join(nodes.withColumnRenamed("node", b), b, "left_semi").select(a, b))
    return saved(labels.join(nodes, "node", "left_anti").select("node", "component").union(components(again, a, b)))


def shown_names(labels: DataFrame, sep: str = " / ") -> DataFrame:
    """Per component: its nodes in order, as one text."""
    return labels.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), sep).alias("display"))


def others(labels: DataFrame) -> DataFrame:
    """Per node: the other nodes of its component."""
    groups = labels.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    return labels.join(groups, "component").select("node", F.array_remove("members", F.col("node")).alias("others"))


def contested(reach: DataFrame, item: str, cluster: str, measures: list[str]) -> DataFrame:
    """Each item goes to the cluster with the largest measures, ties to the smallest cluster."""
    order = F.struct(*(-F.col(m) for m in measures), F.col(cluster))
    return reach.groupBy(item).agg(F.min_by(cluster, order).alias(cluster))
