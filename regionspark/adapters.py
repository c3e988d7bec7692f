"""Relations of the library made from the driver's tables by closed-form arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import segments as seg

WIDTH = HEIGHT = 64
TIES = ["pk", "sk", "ln", "ep", "v"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a canvas of 64 x 64, some of them twice with a shift of at most one row.

    Lines are dealt by image as they are, before boxes and second copies are made of them."""
    names = {"l_orderkey": "image", "l_partkey": "pk", "l_suppkey": "sk", "l_linenumber": "line", "l_extendedprice": "ep", "l_quantity": "n", "l_discount": "d", "l_tax": "t"}
    line = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(name) for c, name in names.items()]).repartition("image")
    copies = F.when(F.col("pk") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = line.withColumn("v", F.explode(copies)).select(
        "image",
        "pk",
        "sk",
        F.col("line").cast("long").alias("ln"),
        "ep",
        (F.col("pk") % 40).alias("x"),
        (F.col("sk") % 40 + F.when(F.col("v") == 1, F.col("pk") % 2).otherwise(0)).alias("y"),
        (1 + F.col("n").cast("long") % 24).alias("w"),
        (1 + 3 * F.col("line")).cast("long").alias("h"),
        (F.round(100 * (1 - F.col("d"))).cast("long") - F.col("v")).alias("iou_pct"),
        F.round(100 * (1 - F.col("t"))).cast("long").alias("stab_pct"),
        "v",
    )
    raw = both.withColumn("area", F.col("w") * F.col("h")).withColumn("iou", F.col("iou_pct") / 100.0).withColumn("stab", F.col("stab_pct") / 100.0)
    return seg.canonical_ids(raw, TIES)


def segment_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.column_intervals(segments(spark, sf_dir), HEIGHT)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of eight columns for each user: events in order of time are pixels in raster order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), place.cast("long").alias("k"), F.col("event_type").alias("label"), F.col("value").alias("grad"))
    return rows.withColumn("x", F.col("k") % 8).withColumn("y", F.floor(F.col("k") / 8))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each customer: orders in order of date."""
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq_key"), step.cast("long").alias("step"), F.col("o_totalprice").alias("foreground"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions, nations, customers and suppliers as one tree."""

    def of(name: str, letter: str, key: str, parent: str | None, up: str, kind: str, area: str | None = None) -> DataFrame:
        above = F.lit(up) if parent is None else F.concat(F.lit(up), F.col(parent).cast("string"))
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("node_id"), above.alias("parent_id"), F.lit(kind).alias("kind"),
            (F.lit(0.0) if area is None else F.col(area)).alias("area"), F.col(key).cast("long").alias("key"),
        )

    root = spark.range(1).select(F.lit("w").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("world").alias("kind"), F.lit(0.0).alias("area"), F.lit(0).cast("long").alias("key"))
    return (
        root.unionByName(of("region", "r", "r_regionkey", None, "w", "region"))
        .unionByName(of("nation", "n", "n_nationkey", "n_regionkey", "r", "nation"))
        .unionByName(of("customer", "c", "c_custkey", "c_nationkey", "n", "customer", "c_acctbal"))
        .unionByName(of("supplier", "s", "s_suppkey", "s_nationkey", "n", "supplier", "s_acctbal"))
    )


def decisions(tree: DataFrame) -> DataFrame:
    """Explicit decisions on some nodes."""
    chosen = (
        F.when((F.col("kind") == "nation") & (F.col("key") % 3 == 0), "keep")
        .when((F.col("kind") == "customer") & (F.col("key") % 50 == 0), "remove")
        .when((F.col("kind") == "region") & (F.col("key") == 2), "remove")
    )
    return tree.select("node_id", chosen.alias("decision")).filter("decision is not null")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image_key"), F.octet_length("html").cast("long").alias("size"))
