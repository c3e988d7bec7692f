"""Queries of documents, requests, paths, exports and pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as ad
from . import plans, sinks
from .catalogue import PIX, SEG
from .functions import documents as doc
from .operators import raster, stores
from .registry import query, rounded

PRESETS = {"fast": {"points": 16, "layers": 0}, "detailed": {"points": 32, "layers": 1}}


@query("""SELECT p_partkey, sha256('{"generator":{"box_nms_thresh":null,"crop_n_layers":' || p_size % 2 || ',"crop_n_points_downscale_factor":null,"min_mask_region_area":null,"multimask_output":null,"points_per_batch":null,"points_per_side":' || p_size ||
  ',"pred_iou_thresh":null,"stability_score_thresh":null,"use_m2m":' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END || '},"model":{"checkpoint_fingerprint":null,"model_id":"' || p_brand || '","sam2_commit":null}}') AS hash FROM part""")
def settings_hash(spark, d):
    n = F.col("p_size")
    made = doc.settings_hash({"points_per_side": n, "crop_n_layers": n % 2, "use_m2m": n % 3 == 0}, {"model_id": F.col("p_brand")})
    return ad.table(spark, d, "part").select("p_partkey", made.alias("hash"))


@query("""SELECT page_id, '{"image_key":"' || page_id || 'ö","size":' || CASE WHEN page_id % 2 = 0 THEN CAST(page_id * 10 AS VARCHAR) ELSE 'null' END || '}' AS document, sha256(html) AS content FROM pages""")
def page_documents(spark, d):
    size = F.when(F.col("page_id") % 2 == 0, F.col("page_id") * 10)
    document = doc.canonical_json({"size": size, "image_key": F.concat(F.col("page_id").cast("string"), F.lit("ö"))})
    return ad.table(spark, d, "pages").select("page_id", document.alias("document"), doc.content_hash(F.col("html").cast("binary")).alias("content"))


@query("""SELECT p_partkey, CASE WHEN p_size % 40 = 16 AND p_partkey % 2 = 0 THEN 'fast' WHEN p_size % 40 = 32 AND p_partkey % 2 = 1 THEN 'detailed' ELSE 'custom' END AS preset FROM part""")
def preset_match(spark, d):
    given = {"points": F.col("p_size") % 40, "layers": (F.col("p_partkey") % 2).cast("int")}
    return ad.table(spark, d, "part").select("p_partkey", doc.preset_of(given, PRESETS).alias("preset"))


@query("""SELECT p_partkey, least(greatest(1, p_size), greatest(1, 2097152000 // ((CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END) * (p_size * CAST(300 AS BIGINT)) * (p_size * CAST(400 AS BIGINT)) * 4))) AS points FROM part""")
def points_per_batch(spark, d):
    n = F.col("p_size").cast("long")
    return ad.table(spark, d, "part").select("p_partkey", doc.points_per_batch(n, n * 300, n * 400, F.col("p_partkey") % 2 == 0).alias("points"))


ROI = SEG + """, m AS (SELECT image, sid, x, y, w, h, greatest(2, CAST(floor(w * CAST(0.25 AS DOUBLE)) AS BIGINT)) AS mx, greatest(2, CAST(floor(h * CAST(0.25 AS DOUBLE)) AS BIGINT)) AS my FROM seg),
r AS (SELECT image, sid, greatest(0, x - mx) AS rx, greatest(0, y - my) AS ry, least(64, x + w + mx) - greatest(0, x - mx) AS rw, least(64, y + h + my) - greatest(0, y - my) AS rh FROM m)"""


@query(ROI + " SELECT image, sid, rx, ry, rw, rh FROM r WHERE rw >= 4 AND rh >= 4")
def roi_of_boxes(spark, d):
    roi = doc.region_of_interest(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 64, 64, 2, 0.25)
    found = ad.segments(spark, d).select("image", "sid", roi.alias("r")).filter("r is not null")
    return found.select("image", "sid", F.col("r.x").alias("rx"), F.col("r.y").alias("ry"), F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


@query(ROI + """, p AS (SELECT r.image, r.sid, t.i, t.px, t.py, rx, ry, rw, rh FROM r, (VALUES (1, 10, 12), (2, 20, 21), (3, 33, 40)) t(i, px, py) WHERE px >= rx AND px < rx + rw AND py >= ry AND py < ry + rh)
SELECT image, sid, string_agg(least(CAST(round_even((px - rx) * CAST(0.5 AS DOUBLE), 0) AS BIGINT), 19) || ':' || least(CAST(round_even((py - ry) * CAST(0.5 AS DOUBLE), 0) AS BIGINT), 19), ',' ORDER BY i) AS points FROM p GROUP BY 1, 2""")
def stroke_points(spark, d):
    roi = doc.region_of_interest(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 64, 64, 2, 0.25)
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 12), (20, 21), (33, 40))])
    placed = ad.segments(spark, d).select("image", "sid", roi.alias("roi")).select("image", "sid", doc.scaled_points(points, F.col("roi"), 0.5, F.lit(20), F.lit(20)).alias("p")).filter("size(p) > 0")
    text = F.array_join(F.transform("p", lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string"))), ",")
    return placed.select("image", "sid", text.alias("points"))


@query(SEG + " SELECT image, sid, least(x + w, x) AS x0, least(y, y + h) AS y0, greatest(x + w, x) AS x1, greatest(y, y + h) AS y1 FROM seg")
def box_normalise(spark, d):
    box = doc.normal_box(F.col("x") + F.col("w"), F.col("y"), F.col("x"), F.col("y") + F.col("h"))
    return ad.segments(spark, d).select("image", "sid", box.alias("b")).select("image", "sid", "b.*")


@query("""SELECT event_id, '{"protocol_version":1,"request_id":' || event_id || ',"command":"' || event_type || '"}' AS request,
  '{"protocol_version":1,"status":"error","event":"error","error_code":"' || CASE event_type WHEN 'click' THEN 'IMAGE_LOAD_FAILED' ELSE 'GENERATION_FAILED' END || '","message":"no"' || CASE WHEN event_id % 2 = 0 THEN ',"request_id":' || event_id ELSE '' END || ',"job_id":"j"}' AS error,
  '{"protocol_version":1,"status":"ok","event":"ready","step":' || user_id || '}' AS event FROM events""")
def messages(spark, d):
    i, kind = F.col("event_id"), F.when(F.col("event_type") == "click", "image_load").otherwise("other")
    return ad.table(spark, d, "events").select(
        "event_id", doc.request(F.col("event_type"), i, 1).alias("request"),
        doc.error(doc.error_code(kind), F.lit("no"), 1, F.when(i % 2 == 0, i), F.lit("j")).alias("error"), doc.event(F.lit("ready"), 1, step=F.col("user_id")).alias("event"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 2 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 4 WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN 3 ELSE 0 END AS code,
  CASE WHEN p_size % 4 <> 0 AND p_size >= 15 THEN CASE WHEN p_size % 4 = 1 THEN 0.0 ELSE 1.0 END ELSE 0.5 END AS disagreement, p_size % 9 <> 0 AS verified FROM part""")
def setup_codes(spark, d):
    n = F.col("p_size")
    score = n / 100.0
    flags = F.create_map(F.lit("imported"), n % 9 != 0, F.lit("executed"), F.lit(True))
    return ad.table(spark, d, "part").select(
        "p_partkey", doc.exit_code(n % 5 != 0, n % 3 != 0, n % 2 == 0, n % 7 != 0, n % 11 != 0).alias("code"),
        doc.guide_disagreement(n % 4, score, F.lit(1), F.lit(0.9)).alias("disagreement"), doc.all_true(flags, ("imported", "executed")).alias("verified"),
    )


@query("""WITH t AS (SELECT p_partkey, ['pan', 'brush', 'ai_click', 'rectangle', 'polygon', 'ai_automatic'][p_size % 6 + 1] AS tool, ['add', 'remove', 'replace'][p_partkey % 3 + 1] AS op FROM part)
SELECT p_partkey, CASE WHEN op = 'replace' OR tool = 'ai_automatic' THEN NULL WHEN tool IN ('pan', 'brush') THEN tool WHEN tool = 'ai_click' THEN 'ai_prompt'
  ELSE CASE tool WHEN 'rectangle' THEN 'rect_' ELSE 'poly_' END || CASE op WHEN 'add' THEN 'add' ELSE 'del' END END AS mode FROM t""")
def edit_modes(spark, d):
    tool = F.get(F.array(*map(F.lit, ("pan", "brush", "ai_click", "rectangle", "polygon", "ai_automatic"))), (F.col("p_size") % 6).cast("int"))
    op = F.get(F.array(*map(F.lit, ("add", "remove", "replace"))), (F.col("p_partkey") % 3).cast("int"))
    return ad.table(spark, d, "part").select("p_partkey", doc.edit_mode(tool, op).alias("mode"))


@query("""WITH s AS (SELECT l_orderkey AS image, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS ids FROM lineitem GROUP BY 1)
SELECT image, array_to_string(list_transform(list_filter(ids, lambda i: i % 2 = 0 OR i = 3), lambda i: CAST(i AS VARCHAR)), ',') AS removed, CAST(len(ids) AS BIGINT) AS n,
  CAST(len(list_filter(ids, lambda i: i <= 4 AND (i % 2 = 0 OR i = 3))) AS BIGINT) AS valid FROM s""")
def decision_maps(spark, d):
    """Maps of all members: even ones removed, then the third."""
    ids = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long"))).alias("ids"))
    made = F.map_from_arrays("ids", F.transform("ids", lambda i: F.when(i % 2 == 0, "remove").otherwise("unreviewed")))
    one = F.when(F.array_contains("ids", F.lit(3).cast("long")), doc.with_decision(made, F.lit(3).cast("long"), F.lit("remove"))).otherwise(made)
    removed = F.array_join(doc.only_removed(one).cast("array<string>"), ",")
    return ids.select("image", removed.alias("removed"), F.size(doc.default_decisions(F.col("ids"))).cast("long").alias("n"), F.size(doc.valid_decisions(one, F.lit(4))).cast("long").alias("valid"))


@query("""SELECT page_id, 'masks_edited/' || page_id || '.d/a.b.png' AS edited, CASE WHEN page_id % 3 = 0 THEN 'masks/own.png' ELSE 'masks/' || page_id || '.d/a.b.png' END AS saved, 'masks_colmap/' || page_id || '.d/a.b.jpg.png' AS exported FROM pages""")
def output_paths(spark, d):
    rel = F.concat(F.col("page_id").cast("string"), F.lit(".d/a.b.jpg"))
    own = F.when(F.col("page_id") % 3 == 0, "masks/own.png")
    return ad.table(spark, d, "pages").select("page_id", doc.edited_path(rel).alias("edited"), doc.save_path(rel, own).alias("saved"), doc.export_path(rel).alias("exported"))


@query("""SELECT 'images/' || p_partkey || '.jpg' AS image_path, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'masks/' || p_partkey || '.png' END AS input_mask_path, '' AS edited_mask_path,
  CASE WHEN p_size % 2 = 0 THEN 'masks_colmap/' || p_partkey || '.jpg.png' ELSE '' END AS colmap_mask_path, CASE WHEN p_size % 4 = 0 THEN 'needs_check' ELSE 'ok' END AS status,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE '64' END AS width, CASE WHEN p_size % 4 = 0 THEN '' ELSE '48' END AS height, CASE WHEN p_size % 4 = 0 THEN '' ELSE '64' END AS mask_width, CASE WHEN p_size % 4 = 0 THEN '' ELSE '48' END AS mask_height,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE printf('%.4f', p_size / CAST(64 AS DOUBLE)) END AS mask_ratio, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 5 = 0 THEN 'True' ELSE 'False' END AS has_intermediate_values,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE 'False' END AS is_empty_mask, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'False' END AS is_full_mask, '' AS note FROM part""")
def check_log_rows(spark, d):
    n, key = F.col("p_size"), F.col("p_partkey").cast("string")
    checked = n % 4 != 0
    rows = ad.table(spark, d, "part").select(
        F.concat(key, F.lit(".jpg")).alias("rel_path"), F.when(n % 3 != 0, F.concat(F.lit("masks/"), key, F.lit(".png"))).alias("mask_path"), (n % 2 == 0).alias("exported"), F.when(checked, "ok").alias("status"),
        *[F.lit(v).alias(c) for c, v in (("width", 64), ("height", 48), ("mask_width", 64), ("mask_height", 48))], (n / 64.0).cast("double").alias("mask_ratio"), (n % 5 == 0).alias("has_intermediate_values"),
        F.lit(False).alias("is_empty_mask"), F.lit(False).alias("is_full_mask"), F.lit(None).cast("string").alias("note"),
    )
    return sinks.check_log(rows)


@query("SELECT count(*) FILTER (p_size % 3 <> 0 AND p_size % 7 <> 0) AS written, count(*) FILTER (p_size % 3 = 0 OR p_size % 7 = 0) AS failed FROM part")
def export_counts(spark, d):
    part, n = ad.table(spark, d, "part"), F.col("p_size")
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    return sinks.export_counts(part.select(name.alias("rel_path"), F.when(n % 3 != 0, name).alias("mask_path")), part.select(name.alias("mask_path"), (n % 7 != 0).alias("readable")))


@query("SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE max(o_orderstatus) END AS status FROM orders GROUP BY o_custkey")
def batch_upsert(spark, d):
    before = ad.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"))
    changed = before.filter("o_custkey % 4 = 0").withColumn("status", F.lit("failed"))
    return sinks.upserted(before, changed, ["o_custkey"], {"status": ("failed", "succeeded")})


@query("""WITH s AS (SELECT l_orderkey AS image, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS ids FROM lineitem GROUP BY 1)
SELECT image, '{"image":' || image || ',"width":64,"height":48,"segment_count":' || len(ids) || ',"segment_ids":[' || array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR)), ',') ||
  '],"decisions":{' || array_to_string(list_transform(ids, lambda i: '"' || i || '":"unreviewed"'), ',') || '}}' AS document FROM s""")
def image_documents(spark, d):
    segments = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("sid")).distinct()
    images = segments.select("image").distinct().select("image", F.lit(64).alias("width"), F.lit(48).alias("height"))
    return sinks.image_documents(images, segments)


@query("""WITH f AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand, string_agg(i || '  ' || p_name || CASE WHEN i = 1 THEN '  (reference)' ELSE '' END, chr(10) ORDER BY i) AS preview FROM f GROUP BY p_brand""")
def order_preview(spark, d):
    from .operators import sequence

    placed = sequence.placed(ad.table(spark, d, "part"), "p_brand", "p_partkey", "p_partkey").withColumn("place", F.col("place") - 1)
    return sequence.preview(placed, "p_brand", "p_name", 1)


@query(SEG + " SELECT image, sid, CAST(round_even(x + CAST(0.5 AS DOUBLE), 0) AS BIGINT) AS x, y, CASE WHEN sid % 3 = 0 THEN 0 ELSE iou END AS iou, x + CAST(0.5 AS DOUBLE) + w / CAST(2 AS DOUBLE) AS px FROM seg")
def annotations_packed(spark, d):
    s = ad.segments(spark, d)
    given = s.select("image", "sid", (F.col("x") + 0.5).alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), F.when(F.col("sid") % 3 != 0, F.col("iou")).alias("iou"), F.lit(None).cast("double").alias("stab"), F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"))
    return stores.packed(given).select("image", "sid", "x", "y", "iou", "px")


@query("""WITH l AS (SELECT l_orderkey AS image, l_linenumber AS sid, CAST(l_quantity AS BIGINT) % 4 AS n, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
SELECT image, i AS sid, CASE n WHEN 0 THEN '' ELSE array_to_string(list_transform(range(n), lambda k: CAST(q + k AS VARCHAR)), ',') END AS counts FROM l""")
def counts_unpacked(spark, d):
    """Stores of one array for each image, with offsets, taken apart again."""
    q = F.col("l_quantity").cast("long")
    runs = F.when(q % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(q % 4 - 1, F.lit(0).cast("long"))), lambda k: q + k))
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", runs.alias("c")).alias("m"))
    members = rows.groupBy("image").agg(F.array_sort(F.collect_list("m")).alias("m"))
    sizes = F.transform("m", lambda m: F.size(m["c"]))
    offsets = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n))
    store = members.select("image", F.flatten(F.transform("m", lambda m: m["c"])).alias("counts"), offsets.alias("offsets"))
    found = stores.unpacked_counts(store)
    return found.select("image", "sid", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


# pixels

FG = PIX + ", fg AS (SELECT image, x, y FROM px WHERE label = 'click'), near(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))"


def clicked(spark, d):
    return ad.pixels(spark, d).filter("label = 'click'").select("image", "x", "y")


@query(FG + " SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM fg, near WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 63")
def mask_dilate(spark, d):
    return raster.dilated(clicked(spark, d), 3, 8, 64)


@query(FG + """ SELECT image, x, y FROM fg f WHERE NOT EXISTS (SELECT 1 FROM near n WHERE f.x + dx BETWEEN 0 AND 7 AND f.y + dy BETWEEN 0 AND 63
  AND NOT EXISTS (SELECT 1 FROM fg g WHERE g.image = f.image AND g.x = f.x + dx AND g.y = f.y + dy))""")
def mask_erode(spark, d):
    return raster.eroded(clicked(spark, d), 3, 8, 64)


@query(PIX + """, t AS (SELECT image, label, x, y FROM px WHERE y < 8) SELECT g.image, CAST(a.x AS BIGINT) AS x, CAST(b.y AS BIGINT) AS y, g.label
FROM range(12) a(x), range(20) b(y) JOIN t g ON g.x = a.x * 8 // 12 AND g.y = b.y * 8 // 20""")
def labels_upscaled(spark, d):
    return raster.resized(ad.pixels(spark, d).filter("y < 8"), (8, 8), (12, 20), "label")


@query(PIX + """ SELECT image, k, CASE WHEN (x - 3) * (x - 3) + (y - 4) * (y - 4) <= 4 THEN 255 WHEN x BETWEEN 5 AND 7 AND y BETWEEN 1 AND 2 THEN 0
  WHEN abs(x - 1) + abs(y - 8) <= 1 THEN 255 WHEN grad > 50 THEN 255 ELSE 0 END AS value FROM px""")
def mask_paint(spark, d):
    px = ad.pixels(spark, d).withColumn("value", F.when(F.col("grad") > 50, 255).otherwise(0))
    x, y = F.col("x"), F.col("y")
    px = raster.painted(px, raster.in_polygon(x, y, [(1, 7), (2, 8), (1, 9), (0, 8)]), True)
    px = raster.painted(px, raster.in_rectangle(x, y, 7, 2, 5, 1), False)
    return raster.painted(px, raster.in_circle(x, y, 3, 4, 2), True).select("image", "k", "value")


@query(PIX + """ SELECT image, k, CASE WHEN k % 9 = 0 OR grad > 127 THEN 255 ELSE 0 END AS mask, CASE WHEN k % 9 = 0 OR grad > 0 THEN 255 ELSE 0 END AS staged,
  CASE WHEN k % 9 = 0 OR grad = 255 THEN 255 ELSE 0 END AS cut, CASE WHEN k % 9 = 0 OR grad >= 128 THEN 255 ELSE 0 END AS candidate FROM px""")
def binarise_rules(spark, d):
    value = F.when(F.col("k") % 9 != 0, F.col("grad"))
    return ad.pixels(spark, d).select("image", "k", *[raster.binarised(value, rule).alias(rule) for rule in raster.RULES])


@query(None)
def small_components_removed(spark, d):
    return raster.without_small(plans.connected_components(ad.pixels(spark, d)), 3)


@query(None)
def enforce_connectivity(spark, d):
    return raster.connected_labels(plans.connected_components(ad.pixels(spark, d), diagonal=False)).select("image", "k", "label", "region")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS best, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 7) AS setting,
  CASE WHEN p_size % 6 = 0 THEN 10 ELSE greatest(5, least(30, p_size)) END AS clamped FROM part""")
def settings_overlaid(spark, d):
    n = F.col("p_size")
    values = F.when(n % 5 == 0, F.array().cast("array<double>")).when(n % 2 == 0, F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9))).otherwise(F.array(F.lit(0.9), F.lit(0.2)))
    text = F.when(n % 6 == 0, "none").otherwise(n.cast("string"))
    return ad.table(spark, d, "part").select("p_partkey", doc.first_best(values).alias("best"), doc.overlaid(F.when(n % 3 == 0, n), F.lit(7)).alias("setting"), doc.clamped(text, 10, 5, 30).alias("clamped"))


@query("""SELECT o_custkey, '{"o_custkey":' || o_custkey || ',"frame_count":' || count(*) || ',"frames":[' || string_agg('{"frame_index":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS document
FROM orders GROUP BY o_custkey""")
def frame_documents(spark, d):
    frames = ad.table(spark, d, "orders").withColumnRenamed("o_orderkey", "frame_index")
    return sinks.frame_documents(frames, "o_custkey", "o_orderstatus")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a' WHEN p_size % 2 = 0 THEN 'b,c' ELSE 'd' END AS ids, CASE p_size % 2 WHEN 0 THEN 'Large' ELSE 'Small' END AS model FROM part""")
def valid_ids(spark, d):
    """Ids by the first list that counts, and the display name of a model from a small dimension."""
    n = F.col("p_size")
    explicit = F.when(n % 3 == 0, F.array(F.lit("a")))
    listed = F.when(n % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    models = spark.createDataFrame([(0, "Large"), (1, "Small")], "model_id int, model string")
    part = ad.table(spark, d, "part").withColumn("model_id", n % 2).join(F.broadcast(models), "model_id")
    return part.select("p_partkey", F.array_join(doc.valid_ids(explicit, listed, F.array(F.lit("d"))), ",").alias("ids"), "model")
