"""More registered queries: label lines, polygons, matching, augmentation of labels, experiments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.functions import names as N
from quadrat.operators import areas, boxes, coco, counting, experiments, filters, matching, metrics, mosaics, tiling
from quadrat.plans import pipeline
from quadrat.plans.catalogue import AREA, KEY, ORACLE, annotations, candidates, labels_with_area, predictions, query, truth
from quadrat.plans.catalogue import _CAND, _IN_TILES, _TILES
from quadrat.plans.views import VIEWS, table, twin, view

VIEWS |= {
    "v_lines": """
        SELECT image_id, class_id, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '1 2 3' WHEN l_linenumber % 3 = 1 THEN ' 1  2 3 4 5 '
               ELSE '1 2 3 4 5 6 7 8 9' END AS raw FROM v_labels""",
    "v_seen_images": "SELECT o_orderkey AS image_id FROM orders WHERE o_orderstatus <> 'P'",
    "v_types": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Platy' WHEN 1 THEN 'Platy ' ELSE 'Other' END AS kind FROM part",
}


def corners(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2"):
    return G.box_polygon(F.col(x1), F.col(y1), F.col(x2), F.col(y2))


# ---- filters ---------------------------------------------------------------------------------------------------------


@query(f"""
    SELECT l.class_id, count(*) AS processed, CAST(count(*) FILTER ({AREA} >= t.min_area) AS BIGINT) AS kept,
           CAST(count(*) FILTER ({AREA} < t.min_area) AS BIGINT) AS removed,
           round(100.0 * count(*) FILTER ({AREA} < t.min_area) / count(*), 4) AS removed_pct
    FROM v_labels l JOIN v_seen_images i ON l.image_id = i.image_id JOIN v_thresholds t ON l.class_id = t.class_id GROUP BY l.class_id""")
def label_filter_guard(spark, d):
    """Labels of images that can't be read are neither kept nor counted."""
    seen = labels_with_area(spark, d).join(view(spark, d, "v_seen_images"), "image_id", "left_semi")
    return areas.filter_statistics(areas.filter_small(seen, view(spark, d, "v_thresholds"), "area"), ["class_id"])


@query("SELECT class_id, count(*) AS n FROM v_preds WHERE conf >= 0.5 GROUP BY class_id")
def confident_predictions(spark, d):
    """C12."""
    return counting.count_by_field(filters.confident(view(spark, d, "v_preds"), 0.5), "class_id")


@query(f"SELECT class_id, count(*) AS n FROM v_preds WHERE {AREA} >= 900 OR l_linenumber = 4 GROUP BY class_id")
def large_predictions(spark, d):
    """Predictions without a polygon pass."""
    rows = view(spark, d, "v_preds").withColumn("polygon", F.when(F.col("l_linenumber") != 4, corners()))
    rows = rows.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return counting.count_by_field(filters.large_enough(rows, "area", 900, "polygon"), "class_id")


@query("SELECT class_id, count(*) AS n FROM v_labels WHERE class_id NOT IN (2) GROUP BY class_id")
def classes_not_ignored(spark, d):
    """C14."""
    return counting.count_by_field(filters.not_in_classes(view(spark, d, "v_labels"), [2]), "class_id")


@query("SELECT image_id, count(*) AS n FROM v_lines WHERE l_linenumber % 3 <> 2 GROUP BY image_id")
def short_label_lines(spark, d):
    """C20."""
    return counting.count_by_field(filters.short_lines(view(spark, d, "v_lines")), "image_id")


@query("SELECT class_id + 3 AS class_id, count(*) AS n FROM v_labels GROUP BY 1")
def relabel_strict(spark, d):
    """Every class must be in the map."""
    return counting.count_by_field(filters.relabel(view(spark, d, "v_labels"), {0: 3, 1: 4, 2: 5}, "fail"), "class_id")


@query("SELECT CASE WHEN trim(kind) = 'Platy' THEN 'Platy' ELSE 'Acro' END AS kind, count(*) AS n FROM v_types GROUP BY 1")
def specimen_types(spark, d):
    """C32."""
    return view(spark, d, "v_types").groupBy(filters.specimen_type(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))


# ---- names and texts -------------------------------------------------------------------------------------------------


@query(f"SELECT CAST(image_id AS VARCHAR) AS stem, count(*) AS n, max(x0) AS x, max(y0) AS y FROM ({_TILES}) GROUP BY image_id")
def tile_parents(spark, d):
    """Tiles counted by the image whose name they carry."""
    t = tiling.tiles(view(spark, d, "v_images"))
    names = t.select(N.tile_name(F.col("image_id").cast("string"), F.col("x0"), F.col("y0")).alias("tile"))
    rows = names.select(N.without_tile(F.col("tile")).alias("stem"), N.tile_origin(F.col("tile")).alias("o"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.max("o.x").alias("x"), F.max("o.y").alias("y"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(n * 0.2)")
def fraction_head(spark, d):
    """G9."""
    return counting.fraction_head(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query("""SELECT image_id, c * (width // 3) AS x0, r * (height // 3) AS y0, (c + 1) * (width // 3) AS x1, (r + 1) * (height // 3) AS y1,
    CASE WHEN image_id % 30 = 23 THEN 'T23' ELSE concat('T', lpad(CAST(image_id % 30 AS VARCHAR), 2, '0'), ' (Done)') END AS folder
    FROM v_images, (SELECT unnest(range(3)) AS r) a, (SELECT unnest(range(3)) AS c) b""")
def segment_names(spark, d):
    """Windows and tray folders read back from names."""
    s = tiling.segments(view(spark, d, "v_images"))
    tray = F.concat(F.lit("T"), (F.col("image_id") % 30).cast("string"))
    s = s.select("image_id", F.concat_ws("_", F.col("image_id").cast("string"), tray, "x0", "y0", "x1", "y1").alias("name"))
    window = N.segment_window(F.col("name")).alias("w")
    return s.select("image_id", window, N.tray_folder(F.get(F.split("name", "_"), F.lit(1))).alias("folder")).select("image_id", "w.*", "folder")


@query("SELECT image_id, CAST(2 * count(*) AS BIGINT) AS n, sum(x1 + x2) AS sx, sum(y1 + y2) AS sy FROM v_labels GROUP BY image_id")
def roi_points(spark, d):
    """Lines with two numbers are points, others go."""
    whole = [F.col(c).cast("bigint").cast("string") for c in ("x1", "y1", "x2", "y2")]
    text = F.concat(whole[0], F.lit("\t"), whole[1], F.lit("\nx 3\n1 2 3\n"), whole[2], F.lit(", "), whole[3])
    rows = view(spark, d, "v_labels").select("image_id", F.explode(N.point_lines(text)).alias("p"))
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"))


@query("SELECT source AS token, count(*) AS n FROM documents GROUP BY source")
def folder_tokens(spark, d):
    """I12."""
    rows = table(spark, d, "documents").select(N.last_token(F.concat_ws("_", F.lit("months"), F.col("lang"), F.col("source"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS n_auto, round(sum(CASE event_type WHEN 'click' THEN 0.25 ELSE 0.5 END), 4) AS total
    FROM events GROUP BY event_type""")
def confidence_lists(spark, d):
    """Lists of confidences in which words stand for none."""
    text = F.concat(F.lit(" Auto,"), F.when(F.col("event_type") == "click", "0.25").otherwise("0.5"), F.lit(", none"))
    rows = table(spark, d, "events").select("event_type", N.conf_list(text).alias("c"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.size(F.filter("c", lambda x: x.isNull()))).alias("n_auto"),
        F.round(F.sum(F.get("c", F.lit(1))), 4).alias("total"),
    )


# ---- geometry --------------------------------------------------------------------------------------------------------


@query(f"""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, round(CASE l_linenumber % 4 WHEN 0 THEN (x2 - x1) / 2000 * ((y2 - y1) / 2000)
    WHEN 1 THEN {AREA} WHEN 2 THEN {AREA} ELSE 0 END, 8) AS area, round({AREA}, 3) AS pixels FROM v_labels""")
def label_areas(spark, d):
    """Areas of label lines by their number of values; pixel areas of fractions."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    k = F.col("l_linenumber") % 4
    coords = (
        F.when(k == 0, F.array(x1 / 2000, y1 / 2000, (x2 - x1) / 2000, (y2 - y1) / 2000)).when(k == 1, F.array(x1, y1, x2, y2))
        .when(k == 2, F.concat(corners(), F.array(F.lit(7.0)))).otherwise(F.array(x1, y1))
    )
    shares = F.transform(corners(), lambda c, i: c / F.when(i % 2 == 0, F.lit(1280.0)).otherwise(F.lit(960.0)))
    pixels = G.pixel_area(shares, F.lit(1280.0), F.lit(960.0))
    return view(spark, d, "v_labels").select("image_id", *KEY, F.round(G.label_area(coords), 8).alias("area"), F.round(pixels, 3).alias("pixels"))


@query("""SELECT l.image_id, l_partkey, l_suppkey, l_linenumber, price, round_even(x1 / 1111 * width, 0) AS px, round_even(y1 / 1111 * height, 0) AS py
    FROM v_labels l JOIN v_images i ON l.image_id = i.image_id""")
def pixel_points(spark, d):
    """Fractions to whole pixels, half to even."""
    rows = view(spark, d, "v_labels").join(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id")
    px = G.points(G.to_pixels(F.array(F.col("x1") / 1111, F.col("y1") / 1111), F.col("width"), F.col("height")))
    return rows.select("image_id", *KEY, F.get(px, F.lit(0)).alias("p")).select("image_id", *KEY, F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM v_labels")
def xywh_boxes(spark, d):
    """Centre form to corners to corner and size."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    box = G.centre_to_corners(x, y, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = view(spark, d, "v_labels").withColumn("b", box).withColumn("v", G.corners_to_xywh(F.col("b")))
    return rows.select("image_id", *KEY, *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xywh")])


@query("""SELECT id, price, CASE WHEN NOT no_segments THEN concat_ws(' ', x1, y1, x1 + w, y1, x1 + w, y1 + h, x1, y1 + h)
    WHEN NOT no_box THEN concat_ws(' ', x1, y1, x1 + w, y1, x1 + w, y1 + h, x1, y1 + h) END AS ring FROM v_coco_anns_base""")
def segmentation_fallback(spark, d):
    """The box's corners where there is no polygon."""
    rows = annotations(spark, d, "base")
    box = F.when(
        F.size("bbox") > 0,
        F.struct(
            F.get("bbox", F.lit(0)).alias("x1"), F.get("bbox", F.lit(1)).alias("y1"),
            (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))).alias("x2"), (F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))).alias("y2"),
        ),
    )
    rows = rows.withColumn("box", box)
    ring = F.get(coco.segmentation_or_box(F.col("segmentation"), F.col("box")), F.lit(0))
    return rows.select("id", "price", F.array_join(ring.cast("array<string>"), " ").alias("ring"))


@query("""SELECT image_id, string_agg(ring, ' ' ORDER BY ring) AS coords FROM
    (SELECT image_id, concat_ws(' ', x1, y1, x2, y1, x2, y2, x1, y2) AS ring FROM v_labels) GROUP BY image_id""")
def joined_rings(spark, d):
    """All rings of an image on one line."""
    ring = F.split(F.array_join(corners().cast("array<string>"), " "), " ")
    rows = view(spark, d, "v_labels").select("image_id", F.array_join(ring, " ").alias("ring"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list("ring")), lambda r: F.split(r, " ")))
    return rows.groupBy("image_id").agg(F.array_join(flat, " ").alias("coords"))


_Q = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 9)]


def _turn(a: int, b: int, c: int) -> str:
    (ax, ay), (bx, by), (cx, cy) = ((f"q[{2 * i + 1}]", f"q[{2 * i + 2}]") for i in (a, b, c))
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _cross(a: int, b: int, c: int, d: int) -> str:
    return f"({_turn(a, b, c)} * {_turn(a, b, d)} <= 0 AND {_turn(c, d, a)} * {_turn(c, d, b)} <= 0)"


@query(f"WITH e AS (SELECT vec_id, [{', '.join(_Q)}] AS q FROM embeddings) SELECT vec_id, NOT ({_cross(0, 1, 2, 3)} OR {_cross(1, 2, 3, 0)}) AS simple FROM e")
def simple_polygons(spark, d):
    """K8."""
    ring = F.transform(F.slice("embedding", 1, 8), lambda c: c.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", G.is_simple(ring).alias("simple"))


@query(f"WITH {_IN_TILES} SELECT image_id, tx, ty, class_id, count(*) AS n, round(sum(inside), 3) AS inside FROM q GROUP BY image_id, tx, ty, class_id")
def tile_polygon_labels(spark, d):
    """J5, K7, K9 for polygons: fractions to pixels, cut to tiles, areas of the parts."""
    images = view(spark, d, "v_images")
    rows = view(spark, d, "v_labels").join(images.select("image_id", "width", "height"), "image_id")
    shares = F.transform(corners(), lambda c, i: c / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    rows = rows.select("image_id", "class_id", shares.alias("coords"))
    parts = tiling.tile_polygons(rows, images, wanted=())
    return parts.groupBy("image_id", "tx", "ty", "class_id").agg(F.count("*").alias("n"), F.round(F.sum("inside"), 3).alias("inside"))


@query("""WITH b AS (SELECT s_suppkey, s_suppkey % 40 AS x1, s_nationkey AS y1, s_suppkey % 40 + 20 AS x2, s_nationkey + 30 AS y2,
      s_suppkey % 17 AS u1, s_nationkey % 7 AS v1, s_suppkey % 17 + 40 AS u2, s_nationkey % 7 + 25 AS v2 FROM supplier),
    i AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS i FROM b)
    SELECT s_suppkey, round(i / (20 * 30 + 40 * 25 - i), 6) AS iou FROM i""")
def raster_overlaps(spark, d):
    """Overlap counted on pixels."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    a = G.box_polygon(s % 40, n, s % 40 + 20, n + 30)
    b = G.box_polygon(s % 17, n % 7, s % 17 + 40, n % 7 + 25)
    rows = table(spark, d, "supplier").select("s_suppkey", a.alias("a"), b.alias("b"))
    return rows.select("s_suppkey", F.round(matching.raster_iou("a", "b", 100), 6).alias("iou"))


# ---- matching --------------------------------------------------------------------------------------------------------


def _greedy(cand: str) -> str:
    """Greedy matches ``taken`` of the relation ``cand`` (image_id, gt_id, pred_id, iou)."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, gt_id, pred_id) AS rn FROM ({cand})),
    w AS (SELECT image_id, gt_id, pred_id, iou, rn, TRUE AS taken, [gt_id] AS gs, [pred_id] AS ps FROM o WHERE rn = 1
      UNION ALL
      SELECT o.image_id, o.gt_id, o.pred_id, o.iou, o.rn, NOT u.used, CASE WHEN u.used THEN w.gs ELSE list_append(w.gs, o.gt_id) END,
             CASE WHEN u.used THEN w.ps ELSE list_append(w.ps, o.pred_id) END
      FROM w JOIN o ON o.image_id = w.image_id AND o.rn = w.rn + 1,
      LATERAL (SELECT list_contains(w.gs, o.gt_id) OR list_contains(w.ps, o.pred_id) AS used) u),
    t AS (SELECT image_id, gt_id, pred_id, iou FROM w WHERE taken)"""


_ROUNDED = "SELECT image_id, gt AS gt_id, pred AS pred_id, round(i / (ga + pa - i), 9) AS iou FROM c WHERE round(i / (ga + pa - i), 9)"
ORACLE["greedy_match_pairs"] = twin(f"WITH RECURSIVE {_CAND}, {_greedy(_ROUNDED + ' > 0')} SELECT image_id, gt_id, pred_id, iou FROM t")
_ROWS = """g AS (SELECT image_id, class_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS gt_id FROM v_labels),
    p AS (SELECT image_id, class_id, conf, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS pred_id FROM v_preds)"""
_LABELS = f"""{_ROWS}, l AS (
      SELECT g.class_id AS true_label, p.class_id AS pred_label FROM t JOIN g ON t.image_id = g.image_id AND t.gt_id = g.gt_id
        JOIN p ON t.image_id = p.image_id AND t.pred_id = p.pred_id
      UNION ALL SELECT class_id, 3 FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = g.image_id AND t.gt_id = g.gt_id)
      UNION ALL SELECT 3, class_id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = p.image_id AND t.pred_id = p.pred_id))"""


def matched(spark, d) -> DataFrame:
    """One-to-one matches of the same class with half overlap."""
    return matching.greedy_match(candidates(spark, d).where("iou >= 0.5"), "gt_id", "pred_id")


def matched_labels(spark, d) -> DataFrame:
    return matching.label_pairs(truth(spark, d), predictions(spark, d), matched(spark, d), "gt_id", "pred_id")


_MATCHED = f"WITH RECURSIVE {_CAND}, {_greedy(_ROUNDED + ' >= 0.5')}, {_LABELS}"
_GRID = "(SELECT unnest(range(4)) :: INT AS true_label) a, (SELECT unnest(range(4)) :: INT AS pred_label) b"


@query(f"""{_MATCHED} SELECT a.true_label, b.pred_label, (SELECT count(*) FROM l WHERE l.true_label = a.true_label AND l.pred_label = b.pred_label) AS n
    FROM {_GRID}""")
def matched_confusion(spark, d):
    """The confusion matrix of what the matcher finds."""
    return metrics.confusion_matrix(matched_labels(spark, d))


@query(f"""{_MATCHED}, k AS (SELECT c AS class_id, count(*) FILTER (true_label = c AND pred_label = c) AS tp,
      count(*) FILTER (true_label <> c AND pred_label = c) AS fp, count(*) FILTER (true_label = c AND pred_label <> c) AS fn,
      count(*) FILTER (true_label <> c AND pred_label <> c) AS tn FROM l, (SELECT unnest(range(3)) :: INT AS c) u GROUP BY c),
    x AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, (tp + tn) / (tp + fp + fn + tn) AS a FROM k)
    SELECT class_id, tp, fp, fn, tn, round(p, 3) AS precision, round(r, 3) AS recall, round(2 * p * r / (p + r), 3) AS f1, round(a, 3) AS accuracy FROM x""")
def matched_metrics(spark, d):
    """L2, F17 from the matcher's pairs."""
    return metrics.class_metrics(matched_labels(spark, d), [0, 1, 2])


@query(f"""WITH RECURSIVE {_CAND}, {_greedy(_ROUNDED + ' >= 0.5')}, {_ROWS},
    h AS (SELECT p.class_id, p.conf, max(CASE WHEN t.pred_id IS NULL THEN 0 ELSE 1 END) AS hit FROM p LEFT JOIN t ON p.image_id = t.image_id AND p.pred_id = t.pred_id GROUP BY p.image_id, p.pred_id, p.class_id, p.conf),
    s AS (SELECT class_id, conf, sum(hit) AS tp, count(*) AS np FROM h GROUP BY class_id, conf),
    u AS (SELECT *, sum(tp) OVER v / sum(np) OVER v AS pr FROM s WINDOW v AS (PARTITION BY class_id ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, max(pr) OVER (PARTITION BY class_id ORDER BY conf DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM u),
    n AS (SELECT class_id, count(*) AS n FROM g GROUP BY class_id)
    SELECT n.class_id, round(sum(tp * env) / min(n.n), 6) AS ap FROM n JOIN e ON e.class_id = n.class_id GROUP BY n.class_id""")
def matched_precision(spark, d):
    """Average precision at half overlap with the matcher's true positives."""
    hits = matched(spark, d).select("image_id", "pred_id", F.lit(True).alias("tp"))
    rows = predictions(spark, d).select("image_id", "pred_id", "class_id", "conf").dropDuplicates().join(hits, ["image_id", "pred_id"], "left")
    counts = truth(spark, d).groupBy("class_id").agg(F.count("*").alias("n"))
    return matching.average_precision(rows.fillna(False, ["tp"]), counts)


@query("""WITH c AS (SELECT g.image_id, g.class_id AS true_label, concat_ws('-', g.l_partkey, g.l_suppkey, g.l_linenumber) AS gt_id,
        concat_ws('-', p.l_partkey, p.l_suppkey, p.l_linenumber) AS pred_id,
        (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i,
        (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa
      FROM v_labels g JOIN v_preds p ON g.image_id = p.image_id AND g.x1 < p.x2 AND p.x1 < g.x2 AND g.y1 < p.y2 AND p.y1 < g.y2),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY round(i / (ga + pa - i), 9) DESC, gt_id) AS rn FROM c WHERE round(i / (ga + pa - i), 9) >= 0.5),
    p AS (SELECT DISTINCT image_id, class_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS pred_id FROM v_preds)
    SELECT coalesce(r.true_label, 3) AS true_label, p.class_id AS pred_label, count(*) AS n
    FROM p LEFT JOIN (SELECT r.image_id, r.pred_id, g.class_id AS true_label FROM r JOIN v_labels g ON r.image_id = g.image_id
        AND r.gt_id = concat_ws('-', g.l_partkey, g.l_suppkey, g.l_linenumber) WHERE r.rn = 1) r ON r.image_id = p.image_id AND r.pred_id = p.pred_id GROUP BY 1, 2""")
def validator_pairs(spark, d):
    """L3: each prediction against the truth that it overlaps most, or the background."""
    near = candidates(spark, d, same_class=False).where("iou >= 0.5")
    return matching.best_or_background(truth(spark, d), predictions(spark, d), near, "gt_id", "pred_id").groupBy("true_label", "pred_label").agg(
        F.count("*").alias("n")
    )


@query(f"""WITH {_CAND}, m AS (SELECT image_id, count(DISTINCT pred) AS pm FROM c WHERE round(i / (ga + pa - i), 9) >= 0.5 GROUP BY image_id),
    g AS (SELECT image_id, count(*) AS ng FROM v_labels GROUP BY image_id), p AS (SELECT image_id, count(*) AS np FROM v_preds GROUP BY image_id),
    a AS (SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np FROM g FULL JOIN p ON g.image_id = p.image_id),
    f AS (SELECT a.image_id FROM a LEFT JOIN m ON a.image_id = m.image_id WHERE CASE WHEN np <> ng THEN np > ng ELSE coalesce(pm, 0) < np END)
    SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) AS rn, count(*) OVER () AS n FROM f) WHERE rn <= floor(n * 0.1)""")
def hard_examples(spark, d):
    """A tenth of the images with false positives; a sampling operator."""
    flags = matching.image_flags(truth(spark, d), predictions(spark, d), candidates(spark, d), "gt_id", "pred_id")
    return counting.fraction_head(flags.where("has_fp").select("image_id"), "image_id", 0.1)


ORACLE["suppressed_predictions"] = twin("""WITH RECURSIVE b AS (SELECT image_id, conf, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS pred_id, class_id, x1, y1, x2, y2 FROM v_preds),
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_id, class_id, x1, y1, x2, y2) AS rn FROM b),
    w AS (SELECT image_id, pred_id, conf, rn, TRUE AS stays, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM o WHERE rn = 1
      UNION ALL
      SELECT o.image_id, o.pred_id, o.conf, o.rn, NOT h.hidden, CASE WHEN h.hidden THEN w.kept ELSE list_append(w.kept, {'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) END
      FROM w JOIN o ON o.image_id = w.image_id AND o.rn = w.rn + 1,
      LATERAL (SELECT len(list_filter(w.kept, lambda k: least(k.x2, o.x2) > greatest(k.x1, o.x1) AND least(k.y2, o.y2) > greatest(k.y1, o.y1)
        AND (least(k.x2, o.x2) - greatest(k.x1, o.x1)) * (least(k.y2, o.y2) - greatest(k.y1, o.y1))
            / least((k.x2 - k.x1) * (k.y2 - k.y1), (o.x2 - o.x1) * (o.y2 - o.y1)) >= 0.2)) > 0 AS hidden) h)
    SELECT image_id, pred_id, conf FROM w WHERE stays""")

ORACLE["class_texts"] = twin("""WITH g AS (SELECT image_id, list_sort(list(DISTINCT class_id)) AS own FROM v_labels GROUP BY image_id),
    o AS (SELECT image_id, own, list_transform(list_sort(list_transform(list_filter(range(5), lambda c: NOT list_contains(own, c)),
        lambda c: concat(md5(concat_ws(':', '3', image_id, c)), c))), lambda s: CAST(right(s, 1) AS INT)) AS rest FROM g),
    k AS (SELECT image_id, own, list_concat(own, rest)[1:4] AS kept FROM o)
    SELECT image_id, array_to_string(list_transform(kept, lambda c: ['a', 'n', 'r', 'x', 'y'][c + 1]), ',') AS texts,
           array_to_string(list_transform(list_filter(own, lambda c: list_contains(kept, c)), lambda c: list_position(kept, c) - 1), ',') AS labels FROM k""")


@query("SELECT category_id, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 3) AS area FROM (SELECT *, CASE class_id WHEN 1 THEN 7 WHEN 2 THEN 9 ELSE 1 END AS category_id FROM v_preds) GROUP BY category_id")
def predicted_annotations(spark, d):
    """Predictions as annotations; unknown names are category 1."""
    box = F.struct("x1", "y1", "x2", "y2")
    name = F.get(F.array(F.lit("other"), F.lit("n"), F.lit("r")), F.col("class_id").cast("int"))
    rows = view(spark, d, "v_preds").select("image_id", "conf", name.alias("class_name"), box.alias("box"), F.array(corners()).alias("polygon"))
    found = coco.from_predictions(rows, {"n": 7, "r": 9})
    return found.groupBy("category_id").agg(F.count("id").alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query("SELECT doc_id, 0.5 + CAST(length(source) AS DOUBLE) / 100 AS conf, length(source) % 3 AS class_id FROM documents")
def model_predictions(spark, d):
    """A model's rows, loaded once a partition."""

    def load():
        def model(rows: pd.DataFrame) -> pd.DataFrame:
            n = rows["source"].str.len()
            return pd.DataFrame({"doc_id": rows["doc_id"], "conf": 0.5 + n / 100, "class_id": n % 3})

        return model

    return matching.predict(table(spark, d, "documents").select("doc_id", "source"), load, "doc_id long, conf double, class_id long")


# ---- augmentation ----------------------------------------------------------------------------------------------------

_FLIP = """f AS (SELECT l.image_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS k, width - x2 AS x1, y1, width - x1 AS x2, y2
    FROM v_labels l JOIN v_images i ON l.image_id = i.image_id)"""


@query(f"""WITH {_FLIP}, c AS (SELECT f.image_id, f.k, (least(f.x2, q.x2) - greatest(f.x1, q.x1)) * (least(f.y2, q.y2) - greatest(f.y1, q.y1))
        / ((q.x2 - q.x1) * (q.y2 - q.y1)) AS c FROM f JOIN v_labels q ON f.image_id = q.image_id AND f.x1 < q.x2 AND q.x1 < f.x2 AND f.y1 < q.y2 AND q.y1 < f.y2),
    m AS (SELECT f.image_id, f.k, coalesce(max(c), 0) AS overlap FROM f LEFT JOIN c ON f.image_id = c.image_id AND f.k = c.k GROUP BY f.image_id, f.k),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY overlap, k) AS pos, count(*) OVER (PARTITION BY image_id) AS n FROM m WHERE overlap < 0.3)
    SELECT image_id, k AS gt_id, round(overlap, 8) AS overlap FROM r WHERE pos <= round_even(n * 0.5, 0)""")
def copy_paste_order(spark, d):
    """Mirrored objects that cover little, the least overlapping half."""
    t = truth(spark, d)
    sized = t.join(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id")
    mirrored = boxes.flip(sized, F.col("width"), F.col("height"))
    found = mosaics.copy_paste(mirrored, t, "gt_id", 0.5)
    return found.select("image_id", "gt_id", F.round("overlap", 8).alias("overlap"))


@query("""WITH s AS (SELECT l.*, least(width, height) AS m, (width - least(width, height)) // 2 AS dx, (height - least(width, height)) // 2 AS dy
      FROM v_labels l JOIN v_images i ON l.image_id = i.image_id),
    c AS (SELECT *, least(greatest(x1 - dx, 0), m) AS a1, least(greatest(y1 - dy, 0), m) AS b1, least(greatest(x2 - dx, 0), m) AS a2, least(greatest(y2 - dy, 0), m) AS b2 FROM s)
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, round(a1 * (224 / m), 6) AS x1, round(b1 * (224 / m), 6) AS y1,
           round(a2 * (224 / m), 6) AS x2, round(b2 * (224 / m), 6) AS y2 FROM c WHERE a1 < a2 AND b1 < b2""")
def centre_crop_boxes(spark, d):
    """M14."""
    rows = view(spark, d, "v_labels").join(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id")
    out = mosaics.centre_crop(rows, F.col("width"), F.col("height"), 224)
    return out.select("image_id", *KEY, *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _placed(spark, d, n: int) -> DataFrame:
    from quadrat.session import ranked_by_key

    ranks = ranked_by_key(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id", "rn")
    at = F.col("rn") - 1
    return ranks.select("image_id", "width", "height", F.floor(at / n).alias("mosaic"), (at % n).alias("place"))


_RANK = "(SELECT image_id, width, height, row_number() OVER (ORDER BY image_id) - 1 AS pos FROM v_images)"


@query(f"""WITH p AS (SELECT image_id, width AS w, height AS h, pos // 4 AS mosaic, pos % 4 AS place FROM {_RANK}),
    a AS (SELECT *, CASE WHEN place IN (0, 2) THEN greatest(1300 - w, 0) ELSE 1300 END AS ax1, CASE WHEN place IN (0, 1) THEN greatest(1100 - h, 0) ELSE 1100 END AS ay1,
        CASE WHEN place IN (0, 2) THEN 1300 ELSE least(1300 + w, 2400) END AS ax2, CASE WHEN place IN (0, 1) THEN 1100 ELSE least(1100 + h, 2400) END AS ay2 FROM p)
    SELECT image_id, mosaic, place, ax1, ay1, ax2, ay2, ax1 - CASE WHEN place IN (0, 2) THEN w - (ax2 - ax1) ELSE 0 END AS dx,
           ay1 - CASE WHEN place IN (0, 1) THEN h - (ay2 - ay1) ELSE 0 END AS dy FROM a""")
def mosaic_four(spark, d):
    """Four images around a centre."""
    out = mosaics.mosaic4(_placed(spark, d, 4), 1200, 1300, 1100)
    return out.select("image_id", "mosaic", "place", "ax1", "ay1", "ax2", "ay2", "dx", "dy")


@query(f"""WITH p AS (SELECT image_id, width AS w, height AS h, pos // 9 AS mosaic, pos % 9 AS place FROM {_RANK}),
    q AS (SELECT *, first_value(w) OVER v AS w0, first_value(h) OVER v AS h0, lag(w) OVER v AS wp, lag(h) OVER v AS hp FROM p WINDOW v AS (PARTITION BY mosaic ORDER BY place)),
    a AS (SELECT *, CASE place WHEN 0 THEN 1200 WHEN 1 THEN 1200 WHEN 2 THEN 1200 + wp WHEN 3 THEN 1200 + w0 WHEN 4 THEN 1200 + w0 WHEN 5 THEN 1200 + w0 - w
          WHEN 6 THEN 1200 + w0 - wp - w ELSE 1200 - w END AS dx,
        CASE place WHEN 0 THEN 1200 WHEN 1 THEN 1200 - h WHEN 2 THEN 1200 - h WHEN 3 THEN 1200 WHEN 4 THEN 1200 + hp WHEN 5 THEN 1200 + h0 WHEN 6 THEN 1200 + h0
          WHEN 7 THEN 1200 + h0 - h ELSE 1200 + h0 - hp - h END AS dy FROM q)
    SELECT image_id, mosaic, place, dx, dy, greatest(dx, 0) AS ax1, greatest(dy, 0) AS ay1, greatest(dx + w, 0) AS ax2, greatest(dy + h, 0) AS ay2 FROM a""")
def mosaic_nine(spark, d):
    """Eight images around one."""
    out = mosaics.mosaic9(_placed(spark, d, 9), 1200)
    return out.select("image_id", "mosaic", "place", "dx", "dy", "ax1", "ay1", "ax2", "ay2")


_SLICES = """SELECT image_id, CAST(least(i * 320, greatest(width - 640, 0)) AS INT) AS x0, CAST(least(j * 320, greatest(height - 640, 0)) AS INT) AS y0,
    CAST(least(least(i * 320, greatest(width - 640, 0)) + 640, width) AS INT) AS x1, CAST(least(least(j * 320, greatest(height - 640, 0)) + 640, height) AS INT) AS y1
    FROM v_images, LATERAL (SELECT unnest(range(1 + CAST(ceil(greatest(width - 640, 0) / 320) AS BIGINT))) AS i) a,
    LATERAL (SELECT unnest(range(1 + CAST(ceil(greatest(height - 640, 0) / 320) AS BIGINT))) AS j) b"""


@query(_SLICES)
def sliced_windows(spark, d):
    """Windows for sliced inference."""
    return mosaics.slices(view(spark, d, "v_images"))


@query(f"""WITH s AS ({_SLICES}) SELECT l.image_id, count(*) AS n, sum(l.x1) AS x1, sum(l.y2) AS y2 FROM v_labels l JOIN s ON l.image_id = s.image_id
    AND l.x1 >= s.x0 AND l.y1 >= s.y0 AND l.x2 <= s.x1 AND l.y2 <= s.y1 GROUP BY l.image_id""")
def sliced_detections(spark, d):
    """Boxes found inside windows, back in coordinates of their image."""
    regions = view(spark, d, "v_labels").select("image_id", "x1", "y1", "x2", "y2")
    inside = boxes.in_own_windows(regions, view(spark, d, "v_images"), lambda rows, keep: mosaics.slices(rows, keep=keep))
    local = inside.withColumns({"x0": F.col("w_x0"), "y0": F.col("w_y0")})
    local = local.withColumns({c: F.col(c) - F.col(f"{c[0]}0") for c in ("x1", "y1", "x2", "y2")})
    return mosaics.from_slices(local).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("x1").alias("x1"), F.sum("y2").alias("y2"))


@query("""WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('5:', CAST(image_id AS VARCHAR))), image_id) AS rn, count(*) OVER () AS n FROM v_images),
    m AS (SELECT a.image_id, b.image_id AS partner FROM r a JOIN r b ON a.rn % a.n + 1 = b.rn)
    SELECT image_id, class_id, count(*) AS n FROM (
      SELECT image_id, class_id FROM v_labels WHERE image_id IN (SELECT image_id FROM m)
      UNION ALL SELECT m.image_id, class_id FROM m JOIN v_labels l ON l.image_id = m.partner) GROUP BY image_id, class_id""")
def mixed_labels(spark, d):
    """M4: labels of an image and of the one that it is mixed with."""
    mates = boxes.partners(view(spark, d, "v_images"), "image_id", 5)
    return boxes.mixed(view(spark, d, "v_labels").select("image_id", "class_id"), mates, "image_id").groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


@query(f"""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, row_number() OVER (PARTITION BY image_id ORDER BY {AREA} DESC, l_partkey, l_suppkey, l_linenumber, price) AS layer
    FROM v_labels""")
def overlap_order(spark, d):
    """Masks of an image are drawn from the largest down."""
    return boxes.layers(labels_with_area(spark, d), "area", KEY).select("image_id", *KEY, "layer")


# ---- experiments, preparation ----------------------------------------------------------------------------------------


@query("""SELECT CAST(i AS INT) AS at, count(*) AS n, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(range(64)) AS i) u GROUP BY i""")
def class_means(spark, d):
    """means over arrays with a value for each class."""
    return experiments.position_means(table(spark, d, "embeddings"), "embedding")


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id % 1000, doc_id) AS rn FROM documents""")
def numeric_suffix_order(spark, d):
    """H7: by the number that a name ends in, not by its digits."""
    name = F.concat(F.lit("data_"), (F.col("doc_id") % 1000).cast("string"))
    rows = table(spark, d, "documents").select("doc_id", name.alias("name"))
    return counting.by_suffix(rows, "name", "doc_id").select("doc_id", "rn")


@query("SELECT image_id, dataset FROM v_images ORDER BY dataset, image_id LIMIT 50")
def head_images(spark, d):
    """The first images of a listing; a limit is the feature."""
    return counting.head(view(spark, d, "v_images").select("image_id", "dataset"), ["dataset", "image_id"], 50)


@query("""WITH m AS (SELECT t AS true_label, p AS pred_label, (SELECT count(*) FROM v_pairs v WHERE v.true_label = t AND v.pred_label = p) AS n
      FROM (SELECT unnest(range(4)) :: INT AS t) a, (SELECT unnest(range(4)) :: INT AS p) b),
    a AS (SELECT true_label AS l, sum(n) AS row, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS dd FROM m GROUP BY 1),
    b AS (SELECT pred_label AS l, sum(n) AS col FROM m GROUP BY 1),
    e AS (SELECT CASE WHEN col > 0 THEN dd / col ELSE 0 END AS r, CASE WHEN row > 0 THEN dd / row ELSE 0 END AS p FROM a JOIN b ON a.l = b.l)
    SELECT round(avg(r), 6) AS recall, round(avg(p), 6) AS precision FROM e""")
def rates_from_text(spark, d):
    """A matrix printed as text, read back and measured."""
    m = metrics.confusion_matrix(view(spark, d, "v_pairs"))
    cells = F.sort_array(F.collect_list(F.struct("pred_label", "n")))
    lines = m.groupBy("true_label").agg(F.array_join(F.transform(cells, lambda c: F.lpad(c["n"].cast("string"), 9, " ")), " ").alias("line"))
    listed = lines.agg(F.sort_array(F.collect_list(F.struct("true_label", "line"))).alias("l"))  # a line a class
    text = F.concat(F.lit("matrix:\n[["), F.array_join(F.transform("l", lambda x: x["line"]), "]\n ["), F.lit("]]\n"))
    back = listed.select(experiments.matrix_from_text(text).alias("m"))
    rows = back.select(F.posexplode("m").alias("true_label", "row")).select("true_label", F.posexplode("row").alias("pred_label", "n"))
    return metrics.matrix_rates(rows.withColumn("n", F.col("n").cast("long"))).select("recall", "precision")


@query("""WITH r AS (SELECT event_type, round(avg(value), 3) AS m, count(*) AS n FROM events GROUP BY event_type)
    SELECT round(avg(m) / 1000, 6) AS map50, round(avg(m) / 2000, 6) AS map50_95 FROM r""")
def mean_precision_text(spark, d):
    """Mean precisions of the class rows of a report, the row of all classes left out."""
    r = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("m"), F.count("*").alias("n"))
    at = F.lit("  0.9  0.8  0.7  0.6  0.5  0.4  ")
    line = F.concat(F.lit("  "), "event_type", F.lit("  10  "), F.col("n").cast("string"), at, F.format_string("%.8f  %.8f", F.col("m") / 1000, F.col("m") / 2000))
    listed = r.agg(F.sort_array(F.collect_list(line)).alias("l"))  # a line a class
    text = F.concat(F.lit("Class Images Instances\n  all  10  99"), at, F.lit("0.3  0.2\n"), F.array_join("l", "\n"))
    found = listed.select(experiments.report_precision(text, []).alias("p"))
    return found.select(F.round("p.map50", 6).alias("map50"), F.round("p.map50_95", 6).alias("map50_95"))


@query(f"""WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id) AS rn, count(*) OVER () - 3 AS m FROM v_images),
    s AS (SELECT image_id, CASE WHEN rn = 1 THEN 'train' WHEN rn = 2 THEN 'val' WHEN rn = 3 THEN 'test' WHEN rn - 3 <= floor(m * 0.7) THEN 'train'
      WHEN rn - 3 <= floor(m * 0.7) + floor(m * 0.15) THEN 'val' ELSE 'test' END AS split FROM r)
    SELECT split, count(DISTINCT s.image_id) AS n_images, count(l.image_id) AS n_labels FROM s LEFT JOIN
      (SELECT image_id FROM v_labels WHERE {AREA} >= CASE class_id WHEN 0 THEN 400 WHEN 1 THEN 500 ELSE 600 END) l ON s.image_id = l.image_id GROUP BY split""")
def prepared_split(spark, d):
    """The step chain with its settings, patching and balancing switched off."""
    images, v = view(spark, d, "v_images").select("image_id", "width", "height"), view(spark, d, "v_labels")
    sized = v.join(images, "image_id")
    shares = F.transform(corners(), lambda c, i: c / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    labels = sized.select("image_id", "class_id", shares.alias("coords"))
    settings = pipeline.Settings.of(
        {
            "filter": {"min_pixel_area": [399.999, 499.999, 599.999]}, "split": {"split_field": None, "seed": 42},
            "patch": {"enabled": False}, "balance": {"enabled": False},
        }
    )
    done, kept = pipeline.prepare(images, labels, settings)
    counted = kept.groupBy("image_id").agg(F.count("*").alias("k"))
    rows = done.join(counted, "image_id", "left")
    return rows.groupBy("split").agg(F.count("*").alias("n_images"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_labels"))


@query("""WITH RECURSIVE b AS (SELECT image_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber, CAST(round(price * 100) AS BIGINT)) AS k, class_id, 10 * discount AS conf, x1, y1, x2, y2,
      row_number() OVER (PARTITION BY image_id ORDER BY concat_ws('-', l_partkey, l_suppkey, l_linenumber, CAST(round(price * 100) AS BIGINT))) AS i FROM v_labels),
    m AS (SELECT p.image_id, p.i, q.i AS j FROM b p JOIN b q ON p.image_id = q.image_id AND p.i < q.i
      AND p.x1 <= q.x2 AND q.x1 <= p.x2 AND p.y1 <= q.y2 AND q.y1 <= p.y2),
    n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, j) AS step FROM m),
    w AS (SELECT image_id, 0 :: BIGINT AS step, [] :: BIGINT[] AS used, [] :: BIGINT[] AS pairs FROM (SELECT DISTINCT image_id FROM b)
      UNION ALL
      SELECT w.image_id, n.step, CASE WHEN list_contains(used, n.i) OR list_contains(used, n.j) THEN used ELSE used || [n.i, n.j] END,
        CASE WHEN list_contains(used, n.i) OR list_contains(used, n.j) THEN pairs ELSE pairs || [n.i * 1000 + n.j] END
      FROM w JOIN n ON n.image_id = w.image_id AND n.step = w.step + 1),
    e AS (SELECT image_id, arg_max(used, step) AS used, arg_max(pairs, step) AS pairs FROM w GROUP BY image_id),
    t AS (SELECT image_id, unnest(pairs) AS ij FROM e)
    SELECT t.image_id, p.k AS gt_id, q.k AS other, CASE WHEN p.conf > q.conf THEN p.class_id ELSE q.class_id END AS class_id,
      (p.conf + q.conf) / 2 AS conf, least(p.x1, q.x1) AS x1, least(p.y1, q.y1) AS y1, greatest(p.x2, q.x2) AS x2, greatest(p.y2, q.y2) AS y2
    FROM t JOIN b p ON p.image_id = t.image_id AND p.i = ij // 1000 JOIN b q ON q.image_id = t.image_id AND q.i = ij % 1000
    UNION ALL
    SELECT b.image_id, k, NULL, class_id, conf, x1, y1, x2, y2 FROM b JOIN e ON e.image_id = b.image_id WHERE NOT list_contains(used, i)""")
def first_overlap_pairs(spark, d):
    """Each box with the first free one that it meets."""
    key = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("price") * 100).cast("long")).alias("gt_id")
    rows = view(spark, d, "v_labels").select("image_id", key, "class_id", (10 * F.col("discount")).alias("conf"), "x1", "y1", "x2", "y2")
    return matching.first_overlaps(rows, "gt_id")
