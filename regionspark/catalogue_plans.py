"""Queries of merge trees, partitions, colours and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from . import plans
from .catalogue import EDGES, PIX
from .catalogue_review import SIGNED, UNDO
from .functions.colour import lab
from .operators import jobs, raster, regions, review
from .plans import flooding, merging, partition
from .registry import query, rounded

SIGNATURES = SIGNED[: SIGNED.rindex("\nSELECT")]
GUIDES = SIGNATURES + """, leaves AS (SELECT DISTINCT image, label FROM px),
best AS (SELECT l.image, l.label, coalesce(p.sid, 0) AS guide_id, coalesce(p.guide, 0.0) AS guide_score FROM leaves l LEFT JOIN placed p ON p.image = l.image AND p.label = l.label AND p.place = 1)"""


def guides(spark: SparkSession, d: str) -> DataFrame:
    """The best segment of each label, where a map and an image have the same number."""
    px = ad.pixels(spark, d)
    samples = regions.even_samples(px, 3).join(px.select("image", "k", "x", "y"), ["image", "k"])
    boxes = regions.features(px).select("image", "label", "x0", "y0", "x1", "y1")
    segments = ad.segments(spark, d).join(px.select("image").distinct(), "image", "left_semi")
    found = raster.signatures(samples, boxes, segments, ad.seg.column_intervals(segments, ad.HEIGHT), ad.HEIGHT)
    return regions.dominant_guides(px.select("image", "label").distinct(), found)


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return regions.features(ad.pixels(spark, d)).withColumnRenamed("std_grad", "std_lum").join(guides(spark, d), ["image", "label"])


@query(GUIDES + " SELECT image, label, guide_id, round(guide_score, 6) AS guide_score FROM best")
def leaf_dominant_guide(spark, d):
    return guides(spark, d).withColumn("guide_score", rounded("guide_score"))


@query(GUIDES + EDGES.removeprefix(PIX) + """, cents AS (SELECT image, label, CAST(round(grad * 100) AS HUGEINT) AS g FROM px),
sums AS (SELECT image, label, count(*) AS area, CAST(sum(g) AS DOUBLE) AS one, CAST(sum(g * g) AS DOUBLE) AS two FROM cents GROUP BY 1, 2),
reg AS (SELECT s.*, one / area / 100 AS m, sqrt(greatest((area * two - one * one) / (CAST(area AS DOUBLE) * area), 0)) / 100 AS d, guide_id AS g, guide_score AS gs
  FROM sums s JOIN best b ON b.image = s.image AND b.label = s.label),
whole AS (SELECT image, sum(area) AS n FROM reg GROUP BY 1),
gaps AS (SELECT e.image, e.a, e.b, abs(x.m - y.m) AS c, sqrt((x.d - y.d) * (x.d - y.d) + (x.m - y.m) * (x.m - y.m)) AS t, e.mean_gradient AS h,
  CASE WHEN x.g <> 0 AND y.g <> 0 AND x.gs >= 0.15 AND y.gs >= 0.15 THEN CASE WHEN x.g = y.g THEN 0.0 ELSE 1.0 END ELSE 0.5 END AS w, least(x.area, y.area) / CAST(n AS DOUBLE) AS z
  FROM edges e JOIN reg x ON x.image = e.image AND x.label = e.a JOIN reg y ON y.image = e.image AND y.label = e.b JOIN whole ON whole.image = e.image),
most AS (SELECT image, max(c) AS c, max(t) AS t, max(h) AS h FROM gaps GROUP BY 1)
SELECT p.image, p.a, p.b, round(0.3 * coalesce(p.c / nullif(m.c, 0), 0) + 0.1 * coalesce(p.t / nullif(m.t, 0), 0) + 0.3 * coalesce(p.h / nullif(m.h, 0), 0) + 0.25 * w + 0.05 * z, 6) AS cost
FROM gaps p JOIN most m ON m.image = p.image""")
def merge_cost_terms(spark, d):
    found = regions.first_costs(regions.adjacency(ad.pixels(spark, d)), leaves(spark, d), merging.WEIGHTS)
    return found.withColumn("cost", rounded("cost"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return merging.merge_hierarchy(leaves(spark, d), regions.adjacency(ad.pixels(spark, d)))


@query(None)
def hierarchy_build(spark, d):
    return hierarchy(spark, d)


@query(None)
def tree_cut(spark, d):
    return plans.tree_cut(hierarchy(spark, d), 3)


# images in colour: whole rows of the maps

PICTURE = PIX + """, whole AS (SELECT image, x, y, k, CAST(floor(grad) AS BIGINT) * 7 % 256 AS red, (k * 29 + image * 5) % 256 AS green, (k * k) % 256 AS blue
  FROM (SELECT *, count(*) OVER (PARTITION BY image, y) AS n FROM px) WHERE n = 8)"""


def picture(spark: SparkSession, d: str) -> DataFrame:
    full = ad.pixels(spark, d).withColumn("n", F.count("*").over(ad.Window.partitionBy("image", "y"))).filter("n = 8")
    k = F.col("k")
    shades = {"red": F.floor("grad") * 7 % 256, "green": (k * 29 + F.col("image") * 5) % 256, "blue": (k * k) % 256}
    return full.select("image", "x", "y", "k", *[c.alias(name) for name, c in shades.items()])


LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
CURVE = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE 7.787 * {0} + 16.0 / 116.0 END"


@query(PICTURE + ", lin AS (SELECT image, k, " + ", ".join(f"{LINEAR.format(f'CAST({c} AS DOUBLE)')} AS {c[0]}" for c in ("red", "green", "blue")) + """ FROM whole),
xyz AS (SELECT image, k, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM lin),
f AS (SELECT image, k, y, """ + ", ".join(f"{CURVE.format(c)} AS f{c}" for c in "xyz") + """ FROM xyz)
SELECT image, k, round(greatest(least(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END * 2.55, 255), 0)) AS light,
  round(greatest(least(500 * (fx - fy) + 128, 255), 0)) AS a, round(greatest(least(200 * (fy - fz) + 128, 255), 0)) AS b FROM f""")
def colour_lab(spark, d):
    light, a, b = lab(*[F.col(c).cast("double") for c in ("red", "green", "blue")])
    return picture(spark, d).select("image", "k", light.alias("light"), a.alias("a"), b.alias("b"))


@query(PICTURE + """, side AS (SELECT image, max(y) AS last FROM whole GROUP BY 1),
part AS (SELECT w.image, w.k, dx, dy, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END AS nx,
    CASE WHEN y + dy < 0 THEN least(1, last) WHEN y + dy > last THEN greatest(last - 1, 0) ELSE y + dy END AS ny
  FROM whole w JOIN side s ON s.image = w.image, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
sums AS (SELECT p.image, p.k, sum(dx * (2 - abs(dy)) * red) AS gx, sum(dy * (2 - abs(dx)) * red) AS gy FROM part p JOIN whole w ON w.image = p.image AND w.x = nx AND w.y = ny GROUP BY 1, 2)
SELECT image, k, round(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)), 6) AS gradient FROM sums""")
def gradient_magnitude(spark, d):
    return raster.gradient(picture(spark, d), "red").select("image", "k", rounded("gradient").alias("gradient"))


@query(PIX + """ SELECT image, k, CASE WHEN (x - 1) * (x - 1) + (y - 1) * (y - 1) <= 1 OR (x - 5) * (x - 5) + (y - 3) * (y - 3) <= 1 OR (x - 5) * (x - 5) + (y - 6) * (y - 6) <= 1
  OR (x BETWEEN 4 AND 6 AND y BETWEEN 3 AND 6)
  OR (4 * (x - 1) + 2 * (y - 1) BETWEEN 0 AND 20 AND abs(2 * (x - 1) - 4 * (y - 1)) <= sqrt(20.0)) THEN 255 ELSE 0 END AS value FROM px""")
def stroke_paint(spark, d):
    """A stroke of two lines and radius 1."""
    px = ad.pixels(spark, d).withColumn("value", F.lit(0))
    return raster.painted(px, raster.in_stroke(F.col("x"), F.col("y"), [(1, 1), (5, 3), (5, 6)], 1), True).select("image", "k", "value")


@query(None)
def watershed_labels(spark, d):
    return flooding.watershed(picture(spark, d), spacing=3)


@query(None)
def partition_labels(spark, d):
    return partition.partition(picture(spark, d), spacing=3, min_area=3)[0]


@query(None)
def partition_tree(spark, d):
    return partition.partition(picture(spark, d), spacing=3, min_area=3)[1]


# edits that keep decisions beside the mask, and jobs


@query(UNDO.replace("CAST(event_id AS VARCHAR) AS v", "CASE WHEN event_id % 5 <> 2 THEN CAST(event_id AS VARCHAR) END AS v").replace("WHEN l.op = 'edit' THEN l.v ", "WHEN l.op = 'edit' THEN coalesce(l.v, f.now) "))
def unified_undo_fold(spark, d):
    """Edits of a mask with the decisions after them; some leave the decisions alone."""
    i = F.col("event_id")
    op = F.when(i % 3 == 1, "undo").when(i % 7 == 3, "redo").otherwise("edit")
    log = ad.table(spark, d, "events").select("user_id", i.alias("seq"), op.alias("op"), F.when(i % 5 != 2, i.cast("string")).alias("value"))
    return review.undo_redo(log, ["user_id"], 4, unchanged=True).withColumn("value", F.coalesce("value", F.lit("")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS image_key, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'IMAGE_LOAD_FAILED' WHEN o_orderkey % 11 = 0 THEN 'GPU_OOM' WHEN o_orderkey % 13 = 0 THEN 'RLE_INVALID' END AS error_code,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 64 WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 16 ELSE 64 END AS INTEGER) AS batch_used,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 6 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS retries,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 4 END AS segments FROM orders""")
def job_results(spark, d):
    """A job over images with injected functions: some cannot be read, some need smaller batches."""

    def load(path: str) -> int:
        number = int(path)
        if number % 7 == 0:
            raise OSError("cannot read")
        return number

    def generate(number: int, batch: int) -> list[dict]:
        if number % 11 == 0 or (number % 3 == 0 and batch > 16):
            raise MemoryError
        if number % 13 == 0:
            raise jobs.InvalidRuns("counts")
        return [{"area": i} for i in range(number % 4)]

    key = F.col("o_orderkey").cast("string")
    found = jobs.each_image(ad.table(spark, d, "orders").select(key.alias("image_key"), key.alias("path")), load, generate, "area: long")
    return found.select("image_key", "status", "error_code", "batch_used", "retries", F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("segments"))


@query("""SELECT event_id AS request_id, CASE WHEN event_type IN ('click', 'view') THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN event_type = 'view' THEN 'seen' WHEN event_type = 'click' THEN upper(event_type) END AS payload, CASE WHEN event_type NOT IN ('click', 'view') THEN 'UNKNOWN_COMMAND' END AS error_code FROM events""")
def commands_dispatched(spark, d):
    def answer(payload):
        return lambda rows: rows.select("request_id", F.lit("ok").alias("status"), payload.alias("payload"), F.lit(None).cast("string").alias("error_code"))

    sent = ad.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("command"))
    handlers = {"click": answer(F.upper("command")), "view": answer(F.lit("seen"))}
    return jobs.dispatched(sent, handlers, ["request_id", "status", "payload", "error_code"])
