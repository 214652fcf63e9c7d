"""A fitted tree ensemble as a table of nodes, evaluated by an expression.

``node_table`` has one row per node of every tree: its split (feature,
threshold, left and right child; feature -1 in a leaf) and its prediction.
The table is what a warehouse can keep, and what SQL can score from.
``one_row`` gathers it to a single value, an array of trees, whose size is
bounded by the model's own settings (trees x 2**(depth + 1) nodes);
``predict`` walks all trees for a row of inputs.  So a step of a recursive
forecast is an expression, where ``transform`` would be a plan of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = "tree int, weight double, node int, feature int, threshold double, left int, right int, prediction double"


def node_table(model, folder: str, saved: bool = False) -> DataFrame:
    """Nodes of a fitted forest or boosted-tree model, read from the files of
    its ``save`` in ``folder`` (shared storage; they must stay)."""
    if not saved:
        model.write().overwrite().save(folder)
    spark = SparkSession.active()
    weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    nodes = spark.read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
    leaf = F.col("n.leftChild") < 0
    return nodes.join(weights, "tree").select(
        "tree", "weight", F.col("n.id").alias("node"), F.when(leaf, -1).otherwise(F.col("n.split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("n.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.prediction").alias("prediction"))


def one_row(nodes: DataFrame, depth: int, mean: bool) -> DataFrame:
    """The whole ensemble as one value ``forest``; ``mean`` divides the sum of
    the trees by their number (a forest), else it is the sum (boosting)."""
    parts = ["feature", "threshold", "left", "right", "prediction"]
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(F.struct("node", *parts))).alias("ns"))
    packed = F.struct("tree", "weight", *[F.col(f"ns.{p}").alias(p) for p in parts])
    row = trees.agg(F.array_sort(F.collect_list(packed)).alias("trees"))
    return row.select(F.struct("trees", F.lit(depth).alias("depth"),
                               (F.size("trees") if mean else F.lit(1)).cast("double").alias("divisor")).alias("forest"))


def of_model(model, folder: str, saved: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node table, one-row ensemble) of a ``spark.ml`` regressor."""
    nodes = node_table(model, folder, saved)
    boosted = "GBT" in type(model).__name__
    return nodes, one_row(nodes, int(model.getOrDefault("maxDepth")), mean=not boosted)


def predict(forest: Column, x: Column) -> Column:
    """Prediction for the inputs ``x`` (an array that is cheap to read again)."""
    def of_tree(t: Column) -> Column:
        def below(n: Column, _: Column) -> Column:
            f = F.get(t["feature"], n)
            return (F.when(f < 0, n).when(F.get(x, f) <= F.get(t["threshold"], n), F.get(t["left"], n))
                    .otherwise(F.get(t["right"], n)))
        leaf = F.aggregate(F.sequence(F.lit(1), F.greatest(forest["depth"], F.lit(1))), F.lit(0), below)
        return F.get(t["prediction"], leaf) * t["weight"]
    total = F.aggregate(F.transform(forest["trees"], of_tree), F.lit(0.0), lambda s, v: s + v)
    return total / forest["divisor"]
