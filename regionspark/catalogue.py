"""The registered queries: operators applied to the adapter relations, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from . import plans, streaming
from .functions import cache_id, safe_name, scaled_side
from .operators import hierarchy, intervals, regions, sequence, state
from .operators import segments as seg
from .registry import REGISTRY, long_, query, rounded

CANVAS = ad.WIDTH * ad.HEIGHT

SEG = """WITH line AS (
  SELECT l_orderkey AS image, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, l_extendedprice AS ep,
    l_partkey % 40 AS x, l_suppkey % 40 AS y, 1 + CAST(l_quantity AS BIGINT) % 24 AS w, 1 + 3 * CAST(l_linenumber AS BIGINT) AS h,
    CAST(round(100 * (1 - l_discount)) AS BIGINT) AS iou_pct, CAST(round(100 * (1 - l_tax)) AS BIGINT) AS stab_pct FROM lineitem),
twice AS (SELECT *, 0 AS v FROM line UNION ALL
  SELECT image, pk, sk, ln, ep, x, y + pk % 2, w, h, iou_pct - 1, stab_pct, 1 FROM line WHERE pk % 3 = 0),
seg AS (SELECT *, w * h AS area, CAST(iou_pct AS DOUBLE) / 100 AS iou, CAST(stab_pct AS DOUBLE) / 100 AS stab,
  row_number() OVER (PARTITION BY image ORDER BY w * h DESC, iou_pct DESC, stab_pct DESC, x, y, w, h, pk, sk, ln, ep, v) AS sid FROM twice)"""
IV = SEG + """, iv AS (SELECT image, sid, v, c * 64 + y AS s, c * 64 + y + h AS e
  FROM (SELECT image, sid, v, y, h, unnest(range(x, x + w)) AS c FROM seg))"""
PX = IV + ", px AS (SELECT image, sid, v, unnest(range(s, e)) AS k FROM iv)"
MEASURES = SEG + """, pairs AS (SELECT a.image, a.sid AS sid_i, b.sid AS sid_j, a.area AS area_i, b.area AS area_j,
    (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS overlap
  FROM seg a JOIN seg b ON a.image = b.image AND a.sid < b.sid AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
m AS (SELECT *, CAST(overlap AS DOUBLE) / (area_i + area_j - overlap) AS iou, CAST(overlap AS DOUBLE) / least(area_i, area_j) AS containment FROM pairs)"""
GROUPS = MEASURES.replace("WITH line", "WITH RECURSIVE line", 1) + """, link AS (SELECT image, sid_i AS a, sid_j AS b FROM m WHERE iou >= 0.85 UNION ALL SELECT image, sid_j, sid_i FROM m WHERE iou >= 0.85),
reach AS (SELECT image, sid, sid AS other FROM seg UNION SELECT r.image, r.sid, l.b FROM reach r JOIN link l ON l.image = r.image AND l.a = r.other),
grouped AS (SELECT image, sid, min(other) AS group_id FROM reach GROUP BY image, sid)"""
SCORED = """scored AS (SELECT image, sid, area, iou * stab AS quality, (x <= 0 OR y <= 0 OR x + w >= 64 OR y + h >= 64) AS edge,
  CAST(0.60 AS DOUBLE) * (CAST(area AS DOUBLE) / max(area) OVER (PARTITION BY image)) + CAST(0.25 AS DOUBLE) * (iou * stab)
  + CAST(0.15 AS DOUBLE) * CASE WHEN x <= 0 OR y <= 0 OR x + w >= 64 OR y + h >= 64 THEN 1 ELSE 0 END AS priority FROM seg)"""
REPS = GROUPS + f""", {SCORED}, rep AS (SELECT s.image, s.sid, s.priority, g.group_id,
  first_value(s.sid) OVER (PARTITION BY s.image, g.group_id ORDER BY s.quality DESC, s.area DESC, s.sid) AS representative
  FROM scored s JOIN grouped g ON g.image = s.image AND g.sid = s.sid)"""
PIX = """WITH pix AS (SELECT user_id AS image, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_type AS label, value AS grad FROM events),
px AS (SELECT *, k % 8 AS x, k // 8 AS y FROM pix)"""
RUNS = PIX + """, marked AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY image ORDER BY k) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS n FROM px),
islands AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS run_idx FROM marked),
runs AS (SELECT image, CAST(run_idx AS BIGINT) AS run_idx, min(label) AS label, min(k) AS s, max(k) + 1 AS e FROM islands GROUP BY image, run_idx)"""
EDGES = PIX + """, near AS (
  SELECT p.image, p.label AS la, p.grad AS ga, q.label AS lb, q.grad AS gb FROM px p JOIN px q ON q.image = p.image AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1))),
edges AS (SELECT image, least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS shared_length, CAST(sum(CAST(round(ga * 100) AS BIGINT) + CAST(round(gb * 100) AS BIGINT)) AS DOUBLE) / count(*) / 200 AS mean_gradient FROM near WHERE la <> lb GROUP BY 1, 2, 3)"""
FRAMES = """WITH frames AS (SELECT o_custkey AS seq_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_totalprice AS foreground FROM orders),
changed AS (SELECT *, CASE WHEN lag(foreground) OVER own <> 0 THEN foreground / lag(foreground) OVER own END AS area_ratio FROM frames WINDOW own AS (PARTITION BY seq_key ORDER BY step))"""
TREE = """WITH RECURSIVE nodes AS (
  SELECT 'w' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'world' AS kind, CAST(0 AS DOUBLE) AS area, CAST(0 AS BIGINT) AS key
  UNION ALL SELECT 'r' || r_regionkey, 'w', 'region', 0, r_regionkey FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', 0, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', c_acctbal, c_custkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier', s_acctbal, s_suppkey FROM supplier),
decided AS (SELECT node_id, CASE WHEN kind = 'nation' AND key % 3 = 0 THEN 'keep' WHEN kind = 'customer' AND key % 50 = 0 THEN 'remove'
  WHEN kind = 'region' AND key = 2 THEN 'remove' END AS decision FROM nodes),
up AS (SELECT node_id, node_id AS ancestor_id, CAST(0 AS BIGINT) AS distance FROM nodes
  UNION ALL SELECT u.node_id, n.parent_id, u.distance + 1 FROM up u JOIN nodes n ON n.node_id = u.ancestor_id WHERE n.parent_id IS NOT NULL)"""
EFFECTIVE = TREE + """, held AS (SELECT u.node_id, arg_min(d.decision, u.distance) AS decision FROM up u JOIN decided d ON d.node_id = u.ancestor_id WHERE d.decision IS NOT NULL GROUP BY 1),
effective AS (SELECT n.node_id, n.kind, n.area, coalesce(h.decision, 'unreviewed') AS decision FROM nodes n LEFT JOIN held h ON h.node_id = n.node_id)"""

def measures(spark: SparkSession, d: str) -> DataFrame:
    return seg.overlap_measures_in_turn(ad.segments(spark, d), *seg.box_runs(F.col, ad.HEIGHT))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return seg.scores(ad.segments(spark, d), ad.WIDTH, ad.HEIGHT)


def represented(spark: SparkSession, d: str) -> DataFrame:
    best_first = [F.desc("quality"), F.desc("area"), "sid"]
    return seg.represented_in_turn(scored(spark, d), *seg.box_runs(F.col, ad.HEIGHT), best_first)


def member_intervals(spark: SparkSession, d: str, condition: str) -> DataFrame:
    """Intervals of the segments for which the condition holds."""
    return seg.column_intervals(ad.segments(spark, d).filter(condition), ad.HEIGHT)


def pixel_counts(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image").agg(F.sum(F.col("e") - F.col("s")).alias("pixels"))


# segments


@query(SEG + " SELECT image, sid, x, y, w, h, area FROM seg")
def seg_canonical_ids(spark, d):
    return ad.segments(spark, d).select("image", "sid", "x", "y", "w", "h", "area")


@query(SEG + f", {SCORED} SELECT image, sid, round(quality, 9) AS quality, round(priority, 9) AS priority FROM scored")
def seg_quality_priority(spark, d):
    return scored(spark, d).select("image", "sid", F.round("quality", 9).alias("quality"), F.round("priority", 9).alias("priority"))


@query(SEG + f", {SCORED} SELECT image, sid FROM scored WHERE edge")
def seg_edge_touch(spark, d):
    return scored(spark, d).filter("edge").select("image", "sid")


@query(SEG + " SELECT image, sid, area FROM seg")
def rle_area_by_segment(spark, d):
    return ad.segment_intervals(spark, d).groupBy("image", "sid").agg(F.sum(F.col("e") - F.col("s")).alias("area"))


RUN_COUNTS = IV + """, gaps AS (SELECT image, sid, s, e, s - coalesce(lag(e) OVER (PARTITION BY image, sid ORDER BY s), 0) AS gap FROM iv)
SELECT image, sid, string_agg(gap || ',' || (e - s), ',' ORDER BY s) || CASE WHEN max(e) < 4096 THEN ',' || (4096 - max(e)) ELSE '' END AS counts FROM gaps GROUP BY image, sid"""


@query(RUN_COUNTS)
def rle_counts_from_intervals(spark, d):
    counts = intervals.run_counts(ad.segment_intervals(spark, d), ["image", "sid"], F.lit(CANVAS))
    return counts.select("image", "sid", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


@query(IV + " SELECT image, sid, s, e FROM iv")
def rle_decode(spark, d):
    counts = intervals.run_counts(ad.segment_intervals(spark, d), ["image", "sid"], F.lit(CANVAS))
    return intervals.decode_runs(counts.withColumn("counts", F.col("counts").cast("array<long>")), ["image", "sid"])


@query(MEASURES + " SELECT image, sid_i, sid_j FROM m")
def bbox_pairs(spark, d):
    return seg.box_pairs(ad.segments(spark, d)).select("image", "sid_i", "sid_j")


@query(MEASURES + " SELECT image, sid_i, sid_j, overlap, round(iou, 6) AS iou, round(containment, 6) AS containment FROM m")
def seg_overlap_iou_containment(spark, d):
    return measures(spark, d).select("image", "sid_i", "sid_j", "overlap", rounded("iou").alias("iou"), rounded("containment").alias("containment"))


@query(GROUPS + " SELECT image, sid, group_id FROM grouped")
def seg_duplicate_groups(spark, d):
    return seg.represented_in_turn(ad.segments(spark, d), *seg.box_runs(F.col, ad.HEIGHT), ["sid"]).select("image", "sid", "group_id")


@query(REPS + " SELECT image, sid, group_id, representative FROM rep")
def seg_representatives(spark, d):
    return represented(spark, d).select("image", "sid", "group_id", "representative")


@query(REPS + " SELECT image, count(DISTINCT group_id) AS groups, count(*) AS members FROM rep GROUP BY image")
def seg_group_counts(spark, d):
    return seg.group_counts_in_turn(ad.segments(spark, d), *seg.box_runs(F.col, ad.HEIGHT))


NEAREST = MEASURES + """, nested AS (SELECT image, CASE WHEN area_j < area_i OR (area_j = area_i AND sid_j > sid_i) THEN sid_j ELSE sid_i END AS sid,
  CASE WHEN area_j < area_i OR (area_j = area_i AND sid_j > sid_i) THEN sid_i ELSE sid_j END AS parent, greatest(area_i, area_j) AS area FROM m WHERE iou < 0.85 AND containment >= 0.95)
SELECT image, sid, parent AS parent_sid FROM (SELECT *, row_number() OVER (PARTITION BY image, sid ORDER BY area, parent) AS n FROM nested) WHERE n = 1"""


@query(NEAREST)
def seg_nearest_parent(spark, d):
    return seg.nearest_parents_in_turn(ad.segments(spark, d), *seg.box_runs(F.col, ad.HEIGHT))


HITS = SEG + """, p(px, py) AS (VALUES (8, 8), (20, 12), (33, 25), (40, 40))
SELECT image, px, py, sid, row_number() OVER (PARTITION BY image, px, py ORDER BY area, sid) AS hit_rank
FROM seg JOIN p ON px >= x AND px < x + w AND py >= y AND py < y + h"""


@query(HITS)
def seg_hit_test(spark, d):
    points = spark.createDataFrame([(8, 8), (20, 12), (33, 25), (40, 40)], "px int, py int")
    return seg.hits(ad.segments(spark, d), points, ad.segment_intervals(spark, d), ad.HEIGHT)


COVERED = PX + """, cover AS (SELECT DISTINCT image, k FROM px WHERE sid % 5 = 0),
part AS (SELECT p.image, p.sid, count(*) AS n FROM px p JOIN cover c ON c.image = p.image AND c.k = p.k GROUP BY 1, 2),
covered AS (SELECT s.image, s.sid, coalesce(p.n, 0) / CAST(s.area AS DOUBLE) AS covered FROM seg s LEFT JOIN part p ON p.image = s.image AND p.sid = s.sid)"""


def covered(spark: SparkSession, d: str) -> DataFrame:
    cover = intervals.union(member_intervals(spark, d, "sid % 5 = 0"))
    return intervals.covered_ratio(ad.segment_intervals(spark, d), cover, ad.segments(spark, d))


@query(COVERED + " SELECT image, sid, round(covered, 6) AS covered FROM covered")
def seg_covered(spark, d):
    return covered(spark, d).select("image", "sid", rounded("covered").alias("covered"))


@query(REPS + """, px AS (SELECT image, sid, k FROM (SELECT image, sid, unnest(range(s, e)) AS k FROM (SELECT image, sid, c * 64 + y AS s, c * 64 + y + h AS e
  FROM (SELECT image, sid, y, h, unnest(range(x, x + w)) AS c FROM seg)))), cover AS (SELECT DISTINCT image, k FROM px WHERE sid % 5 = 0),
part AS (SELECT p.image, p.sid, count(*) AS n FROM px p JOIN cover c ON c.image = p.image AND c.k = p.k GROUP BY 1, 2),
hidden AS (SELECT s.image, s.sid FROM seg s JOIN part p ON p.image = s.image AND p.sid = s.sid WHERE s.sid % 5 <> 0 AND 100 * p.n >= 98 * s.area),
shown AS (SELECT * FROM rep WHERE sid = representative AND (image, sid) NOT IN (SELECT image, sid FROM hidden))
SELECT image, sid, row_number() OVER (PARTITION BY image ORDER BY round(priority, 9) DESC, sid) AS shown_rank FROM shown""")
def seg_visible_sorted(spark, d):
    """Every fifth segment is removed; what these cover is hidden, but they are not."""
    rows = scored(spark, d).select("image", "sid", "x", "y", "w", "h", "area", "quality", F.round("priority", 9).alias("priority"))
    return seg.visible_in_turn(rows, *seg.box_runs(F.col, ad.HEIGHT), F.col("sid") % 5 == 0)


# masks


@query(IV + """, o AS (SELECT image, s, e, max(e) OVER (PARTITION BY image ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT image, s, e FROM iv)),
g AS (SELECT image, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT image, min(s) AS s, max(e) AS e FROM g GROUP BY image, island""")
def mask_union_intervals(spark, d):
    return intervals.union(ad.segment_intervals(spark, d))


SIDES = PX + ", side AS (SELECT image, k, bool_or(v = 0) AS base, bool_or(v = 1) AS added, bool_or(sid % 5 = 0) AS removed, bool_or(sid % 3 = 0) AS wanted FROM px GROUP BY image, k)"


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE base AND NOT removed GROUP BY image")
def mask_compose_exclude(spark, d):
    return pixel_counts(intervals.exclude(member_intervals(spark, d, "v = 0"), member_intervals(spark, d, "sid % 5 = 0")))


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE wanted GROUP BY image")
def mask_compose_keep(spark, d):
    return pixel_counts(intervals.union(member_intervals(spark, d, "sid % 3 = 0")))


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE (base OR added) AND NOT removed GROUP BY image")
def mask_compose_add_remove(spark, d):
    return pixel_counts(intervals.add_remove(*(member_intervals(spark, d, c) for c in ("v = 0", "v = 1", "sid % 5 = 0"))))


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE base OR added GROUP BY image")
def mask_apply_add(spark, d):
    both = {"a": member_intervals(spark, d, "v = 0"), "b": member_intervals(spark, d, "v = 1")}
    return pixel_counts(intervals.combine(both, lambda c: c["a"] | c["b"]))


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE base AND NOT added GROUP BY image")
def mask_apply_exclude(spark, d):
    return pixel_counts(intervals.exclude(member_intervals(spark, d, "v = 0"), member_intervals(spark, d, "v = 1")))


@query(SIDES + " SELECT image, count(*) AS pixels FROM side WHERE added GROUP BY image")
def mask_apply_replace(spark, d):
    return pixel_counts(intervals.union(member_intervals(spark, d, "v = 1")))


@query(SIDES + " SELECT image, count(*) FILTER (added AND NOT base) AS added, count(*) FILTER (base AND NOT added) AS removed, count(*) FILTER (base AND added) AS kept FROM side GROUP BY image")
def mask_diff_counts(spark, d):
    return intervals.difference_counts(member_intervals(spark, d, "v = 0"), member_intervals(spark, d, "v = 1"))


@query(SIDES + """ SELECT image, count(*) FILTER (base) AS base_pixels, count(*) FILTER (removed) AS removed_pixels, count(*) FILTER (base AND NOT removed) AS effective_pixels,
  round(count(*) FILTER (base AND NOT removed) / CAST(4096 AS DOUBLE), 6) AS effective_ratio FROM side WHERE base OR removed GROUP BY image""")
def pixel_stats(spark, d):
    stats = intervals.pixel_stats(member_intervals(spark, d, "v = 0"), member_intervals(spark, d, "sid % 5 = 0"), CANVAS)
    return stats.withColumn("effective_ratio", rounded("effective_ratio"))


# decisions


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    made = ad.segments(spark, d).select("image", "sid", F.when(F.col("sid") % 3 == 0, "remove").when(F.col("sid") % 3 == 1, "keep").alias("decision")).filter("decision is not null")
    return state.normalised(ad.segments(spark, d), made, ["image", "sid"])


DECIDED = SEG + ", decided AS (SELECT image, sid, CASE sid % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'keep' ELSE 'unreviewed' END AS decision FROM seg)"


@query(DECIDED + " SELECT image, sid, decision FROM decided")
def decisions_normalised(spark, d):
    return reviewed(spark, d)


@query(DECIDED + """ SELECT image, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'remove') AS remove,
  count(*) FILTER (decision = 'unreviewed') AS unreviewed, count(*) FILTER (decision = 'unreviewed') = 0 AS complete FROM decided GROUP BY image""")
def decision_counts(spark, d):
    return state.decision_counts(reviewed(spark, d), "image")


# label maps


@query(RUNS + " SELECT image, run_idx, label, s, e FROM runs")
def label_rle_encode(spark, d):
    return regions.label_runs(ad.pixels(spark, d)).select("image", long_("run_idx").alias("run_idx"), "label", "s", "e")


@query(PIX + " SELECT image, label, k FROM px")
def label_rle_decode(spark, d):
    return regions.decode(regions.label_runs(ad.pixels(spark, d)))


@query(PIX + " SELECT image, k, label FROM px WHERE k IN (0, 3, 9, 20)")
def region_at_point(spark, d):
    points = spark.createDataFrame([(0,), (3,), (9,), (20,)], "k long")
    return regions.region_at(regions.label_runs(ad.pixels(spark, d)), points)


FEATURES = PIX + """, cents AS (SELECT *, CAST(round(grad * 100) AS HUGEINT) AS g FROM px),
sums AS (SELECT image, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(x) AS cx, avg(y) AS cy,
  CAST(sum(g) AS DOUBLE) AS one, CAST(sum(g * g) AS DOUBLE) AS two FROM cents GROUP BY image, label)
SELECT image, label, area, x0, y0, x1, y1, round(cx, 9) AS cx, round(cy, 9) AS cy, round(one / area / 100, 9) AS mean_grad,
  round(sqrt(greatest((area * two - one * one) / (CAST(area AS DOUBLE) * area), 0)) / 100, 9) AS std_grad FROM sums"""


@query(FEATURES)
def region_features(spark, d):
    found = regions.features(ad.pixels(spark, d))
    return found.select("image", "label", "area", "x0", "y0", "x1", "y1", *[rounded(c, 9).alias(c) for c in ("cx", "cy", "mean_grad", "std_grad")])


@query(EDGES + " SELECT image, a, b, shared_length, round(mean_gradient, 9) AS mean_gradient FROM edges")
def region_adjacency(spark, d):
    return regions.adjacency(ad.pixels(spark, d)).withColumn("mean_gradient", rounded("mean_gradient", 9))


@query(PIX + """, same AS (SELECT p.image, p.label, p.k, count(q.k) AS n FROM px p LEFT JOIN px q ON q.image = p.image AND q.label = p.label AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY 1, 2, 3)
SELECT image, label, count(*) FILTER (n < 4) AS boundary FROM same GROUP BY image, label""")
def region_boundary(spark, d):
    return regions.boundary(ad.pixels(spark, d))


@query(PIX + """, areas AS (SELECT image, label, count(*) AS area FROM px GROUP BY 1, 2)
SELECT image, CAST(sum(area) AS BIGINT) AS assigned, count(*) AS regions, min(area) AS min_area, max(area) AS max_area, CAST(floor(median(area)) AS BIGINT) AS median_area,
  CAST(ceil(sum(area) / 8.0) * 8 AS BIGINT) AS total, round(sum(area) / (ceil(sum(area) / 8.0) * 8), 6) AS assigned_ratio FROM areas GROUP BY image""")
def region_coverage(spark, d):
    found = regions.coverage(ad.pixels(spark, d), 8)
    return found.withColumn("total", long_("total")).withColumn("assigned_ratio", rounded("assigned_ratio"))


@query(PIX + """, ranked AS (SELECT image, label, k, row_number() OVER (PARTITION BY image, label ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY image, label) AS n FROM px)
SELECT image, label, k FROM ranked WHERE n <= 3 OR r = 0 OR r = CAST(floor((n - 1) / 2.0) AS BIGINT) OR r = n - 1""")
def leaf_even_samples(spark, d):
    return regions.even_samples(ad.pixels(spark, d), 3)


COSTS = EDGES + """, reg AS (SELECT image, label, avg(grad) AS mg, count(*) AS area FROM px GROUP BY 1, 2),
terms AS (SELECT e.image, e.a, e.b, abs(x.mg - y.mg) AS c, e.mean_gradient AS g, CAST(least(x.area, y.area) AS DOUBLE) AS small
  FROM edges e JOIN reg x ON x.image = e.image AND x.label = e.a JOIN reg y ON y.image = e.image AND y.label = e.b),
most AS (SELECT image, max(c) AS c, max(g) AS g, max(small) AS small FROM terms GROUP BY 1)
SELECT t.image, t.a, t.b, round(CASE WHEN m.c <= 0 THEN 0 ELSE 0.5 * least(t.c / m.c, 1) END + CASE WHEN m.g <= 0 THEN 0 ELSE 0.3 * least(t.g / m.g, 1) END
  + CASE WHEN m.small <= 0 THEN 0 ELSE 0.2 * least(t.small / m.small, 1) END, 4) AS cost FROM terms t JOIN most m ON m.image = t.image"""


@query(COSTS)
def merge_cost_initial(spark, d):
    px = ad.pixels(spark, d)
    return regions.merge_costs(regions.adjacency(px), regions.features(px)).withColumn("cost", F.round("cost", 4))


# trees


@query(TREE + " SELECT node_id, ancestor_id, distance FROM up")
def tree_closure(spark, d):
    return hierarchy.ancestors(ad.nodes(spark, d)).select("node_id", "ancestor_id", "distance")


@query(TREE + " SELECT n.node_id, count(u.node_id) AS descendants FROM nodes n LEFT JOIN up u ON u.ancestor_id = n.node_id AND u.distance > 0 GROUP BY 1")
def tree_descendants(spark, d):
    return hierarchy.descendant_counts(ad.nodes(spark, d))


@query(EFFECTIVE + " SELECT node_id, kind, decision FROM effective")
def tree_effective_decision(spark, d):
    tree = ad.nodes(spark, d)
    return hierarchy.effective_decisions(tree, ad.decisions(tree))


@query(EFFECTIVE + " SELECT decision, count(*) AS leaves, round(sum(area), 2) AS area FROM effective WHERE kind IN ('customer', 'supplier') GROUP BY 1")
def tree_pixel_rates(spark, d):
    tree = ad.nodes(spark, d)
    found = hierarchy.effective_decisions(tree, ad.decisions(tree)).join(tree.select("node_id", "area"), "node_id")
    cents = F.sum(F.round(F.col("area") * 100).cast("long"))
    return found.filter("kind in ('customer', 'supplier')").groupBy("decision").agg(F.count("*").alias("leaves"), F.round(cents / 100.0, 2).alias("area"))


@query(TREE + """, broken AS (SELECT node_id, CASE WHEN kind = 'customer' AND key % 97 = 0 THEN 'nowhere' WHEN kind = 'customer' AND key % 89 = 0 THEN node_id ELSE parent_id END AS parent_id FROM nodes
  UNION ALL SELECT node_id, parent_id FROM nodes WHERE kind = 'supplier' AND key % 7 = 0)
SELECT node_id, 'missing parent' AS problem FROM broken WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT node_id, 'own parent' FROM broken WHERE parent_id = node_id UNION ALL SELECT node_id, 'id twice' FROM broken GROUP BY node_id HAVING count(*) > 1""")
def tree_validate(spark, d):
    """A tree in which some customers have no or a wrong parent and some suppliers are there twice."""
    tree, customer = ad.nodes(spark, d), F.col("kind") == "customer"
    parent = F.when(customer & (F.col("key") % 97 == 0), "nowhere").when(customer & (F.col("key") % 89 == 0), F.col("node_id")).otherwise(F.col("parent_id"))
    return hierarchy.violations(tree.withColumn("parent_id", parent).unionByName(tree.filter("kind = 'supplier' and key % 7 = 0")))


# sequences


@query(FRAMES + " SELECT seq_key, step, round(area_ratio, 6) AS area_ratio FROM changed")
def frame_lag_ratio(spark, d):
    return sequence.change(ad.frames(spark, d)).select("seq_key", "step", rounded("area_ratio").alias("area_ratio"))


@query(FRAMES + """, ref AS (SELECT seq_key, max(step) // 2 + 1 AS reference FROM frames GROUP BY 1),
chosen AS (SELECT f.seq_key, f.step, r.reference FROM frames f JOIN ref r ON r.seq_key = f.seq_key WHERE abs(f.step - r.reference) <= 3)
SELECT seq_key, step, reference - min(step) OVER (PARTITION BY seq_key) AS reference_index FROM chosen""")
def frame_select_range(spark, d):
    frames = ad.frames(spark, d)
    reference = frames.groupBy("seq_key").agg(F.expr("max(step) div 2 + 1").alias("step"))
    return sequence.around(frames, reference, 3)


@query(FRAMES + """, ref AS (SELECT seq_key, max(step) // 2 + 1 AS reference FROM frames GROUP BY 1)
SELECT f.seq_key, f.step, row_number() OVER (PARTITION BY f.seq_key ORDER BY f.step) - 1 AS place, f.step = r.reference AS is_reference
FROM frames f JOIN ref r ON r.seq_key = f.seq_key WHERE f.step % 4 = 1 OR f.step = r.reference""")
def frame_select_explicit(spark, d):
    frames = ad.frames(spark, d)
    reference = frames.groupBy("seq_key").agg(F.expr("max(step) div 2 + 1").alias("step"))
    return sequence.chosen(frames, frames.filter("step % 4 = 1"), reference)


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END ASC NULLS LAST, o_orderkey) AS place FROM orders""")
def order_capture(spark, d):
    rows = ad.table(spark, d, "orders").withColumn("taken", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return sequence.placed(rows, "o_custkey", "taken", "o_orderkey").select("o_orderkey", "place")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 3 <> 0 THEN p_size END ASC NULLS LAST, p_partkey) AS place FROM part""")
def order_registered(spark, d):
    rows = ad.table(spark, d, "part").withColumn("registration_index", F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    return sequence.placed(rows, "p_brand", "registration_index", "p_partkey").select("p_partkey", "place")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(spark, d):
    return sequence.keep_first(ad.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT n_regionkey, n_name, coalesce(lead(n_name) OVER own, first_value(n_name) OVER own) AS next_item,
  coalesce(lag(n_name) OVER own, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_item
FROM nation WINDOW own AS (PARTITION BY n_regionkey ORDER BY n_name)""")
def next_prev_circular(spark, d):
    return sequence.circular(ad.table(spark, d, "nation"), "n_regionkey", "n_name")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def order_natural(spark, d):
    """Names without padding, so that 10 comes after 9 only in natural order."""
    names = ad.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("IMG_"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("name"))
    return sequence.naturally_ordered(names, "c_custkey", "name").select("c_custkey", "place")


# keys, states and summaries


@query("SELECT page_id, substr(sha256(url), 1, 16) AS cache_id FROM pages")
def cache_id_hash(spark, d):
    return ad.pages(spark, d).select("page_id", cache_id(F.col("image_key")).alias("cache_id"))


@query("SELECT page_id, lpad(CAST(page_id AS VARCHAR), CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '__' || replace(replace(replace(url, '/', '_'), chr(92), '_'), ':', '_') || '.png' AS file_name FROM pages")
def safe_file_names(spark, d):
    return ad.pages(spark, d).select("page_id", safe_name(F.col("page_id"), F.col("image_key")).alias("file_name"))


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 13 = 0 THEN 'corrupt' WHEN page_id % 5 = 0 THEN 'stale'
  WHEN octet_length(encode(html)) < 200 THEN 'corrupt' WHEN page_id % 7 = 0 THEN 'stale' ELSE 'reusable' END AS state FROM pages""")
def cache_state(spark, d):
    i = F.col("page_id")
    made = state.cache_state(i % 11 == 0, i % 13 == 0, i % 5 == 0, F.col("size") < 200, i % 7 == 0)
    return ad.pages(spark, d).select("page_id", made.alias("state"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def scope_unprocessed(spark, d):
    images, done = ad.table(spark, d, "customer"), ad.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return state.scope_without(images, done, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def scope_failed(spark, d):
    failed = ad.table(spark, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return state.scope_with(ad.table(spark, d, "customer"), failed, "c_custkey").select("c_custkey")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_summary(spark, d):
    return state.summary(ad.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")


@query("""SELECT p_partkey, CASE WHEN greatest(p_size, 30) > 40 AND 40 > 0 THEN greatest(1, CAST(round_even(p_size * (CAST(40 AS DOUBLE) / greatest(p_size, 30)), 0) AS BIGINT)) ELSE p_size END AS side FROM part""")
def working_size(spark, d):
    part = ad.table(spark, d, "part").withColumn("longer", F.greatest("p_size", F.lit(30)))
    return part.select("p_partkey", scaled_side(F.col("p_size"), F.col("longer"), 40).alias("side"))


@query(None)
def connected_components_8(spark, d):
    return plans.connected_components(ad.pixels(spark, d))


@query(None)
def merge_small(spark, d):
    px = ad.pixels(spark, d)
    means = px.groupBy("image", "label").agg(F.count("*").alias("area"), F.avg("grad").alias("grad"))
    return plans.small_regions_merged(means, regions.adjacency(px), 8, ("grad",))


@query("""WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 4 = 3 AS back, event_type AS decision FROM events),
fold AS (SELECT user_id, CAST(0 AS BIGINT) AS i, ['unreviewed'] AS stack FROM (SELECT DISTINCT user_id FROM log)
  UNION ALL SELECT f.user_id, l.i, CASE WHEN l.back THEN CASE WHEN len(f.stack) > 1 THEN f.stack[1:len(f.stack) - 1] ELSE f.stack END
    WHEN l.decision = f.stack[len(f.stack)] THEN f.stack ELSE list_append(f.stack, l.decision) END FROM fold f JOIN log l ON l.user_id = f.user_id AND l.i = f.i + 1)
SELECT user_id, arg_max(stack[len(stack)], i) AS decision, arg_max(len(stack) - 1, i) AS depth FROM fold GROUP BY user_id""")
def edit_log_last_decision(spark, d):
    """Every fourth event takes a step back."""
    op = F.when(F.col("event_id") % 4 == 3, "undo").otherwise("set")
    log = ad.table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("decision"))
    return streaming.folded_decisions(log, ["user_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_plans, catalogue_review, catalogue_scalars  # noqa: F401  they register their queries

    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: REGISTRY[name][1] for name in queries() if REGISTRY[name][1]}
