"""The registered queries of the annotation operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat import session as S
from quadrat.functions import geometry as G
from quadrat.functions import names as N
from quadrat.functions import rle
from quadrat.operators import areas, boxes, coco, counting, experiments, filters, matching, metrics, splitting, tiling
from quadrat.plans.views import table, twin, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEY = ["l_partkey", "l_suppkey", "l_linenumber", "price"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its twin."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = twin(sql)
        return f

    return register


def labels_with_area(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the area of their box, in closed form: a polygon of four right angles needs no fold."""
    v = view(spark, d, "v_labels")
    return v.withColumn("area", G.box_area({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}))


# ---- areas -------------------------------------------------------------------------------------------------------

AREA = "(x2 - x1) * (y2 - y1)"


@query(f"""
    SELECT l.class_id, count(*) AS processed, CAST(sum(CASE WHEN {AREA} >= t.min_area THEN 1 ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN {AREA} >= t.min_area THEN 0 ELSE 1 END) AS BIGINT) AS removed,
           round(100.0 * sum(CASE WHEN {AREA} >= t.min_area THEN 0 ELSE 1 END) / count(*), 4) AS removed_pct
    FROM v_labels l JOIN v_thresholds t ON l.class_id = t.class_id GROUP BY l.class_id""")
def label_filter_stats(spark, d):
    """How many labels of each class reach its least area."""
    judged = areas.filter_small(labels_with_area(spark, d), view(spark, d, "v_thresholds"), "area")
    return areas.filter_statistics(judged, ["class_id"])


@query(f"""
    SELECT i.dataset, l.class_id, count(*) AS processed,
           CAST(sum(CASE WHEN {AREA} >= t.min_area THEN 1 ELSE 0 END) AS BIGINT) AS kept
    FROM v_labels l JOIN v_thresholds t ON l.class_id = t.class_id JOIN v_images i ON l.image_id = i.image_id
    GROUP BY ROLLUP (i.dataset, l.class_id)""")
def label_filter_rollup(spark, d):
    """F7 by data set and class, with totals of both."""
    judged = areas.filter_small(labels_with_area(spark, d), view(spark, d, "v_thresholds"), "area")
    named = judged.join(view(spark, d, "v_images").select("image_id", "dataset"), "image_id")
    return named.rollup("dataset", "class_id").agg(F.count("*").alias("processed"), F.count_if("kept").alias("kept"))


@query(f"""
    SELECT class_id, count(*) AS n, min(area) AS least, max(area) AS largest, round(avg(area), 4) AS mean
    FROM (SELECT class_id, {AREA} AS area FROM v_labels) GROUP BY class_id""")
def label_area_by_class(spark, d):
    """I30, F4."""
    return areas.area_statistics(labels_with_area(spark, d), "area", ["class_id"], 4).select("class_id", "n", "least", "largest", "mean")


@query(f"""
    SELECT count(*) AS n, min(a) AS least, max(a) AS largest, round(avg(a), 4) AS mean,
           round(quantile_cont(a, 0.01), 4) AS p1, round(quantile_cont(a, 0.05), 4) AS p5, round(quantile_cont(a, 0.1), 4) AS p10,
           round(quantile_cont(a, 0.25), 4) AS p25, round(quantile_cont(a, 0.5), 4) AS p50
    FROM (SELECT {AREA} AS a FROM v_labels)""")
def label_area_percentiles(spark, d):
    """F3."""
    return areas.area_statistics(labels_with_area(spark, d), "area", None, 4)


@query(f"""
    WITH a AS (SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, class_id, {AREA} AS area FROM v_labels
               WHERE class_id IN (0, 1) AND {AREA} <= 1500),
         b AS (SELECT quantile_cont(area, 0.25) AS bound FROM a)
    SELECT class_id, count(*) AS n, max(area) AS largest FROM a, b WHERE area <= bound AND area > 0 GROUP BY class_id""")
def label_selection(spark, d):
    """Class, upper bound, percentile bound, positive areas."""
    kept = areas.select_labels(labels_with_area(spark, d), "area", [0, 1], 1500, 0.25, True)
    return kept.groupBy("class_id").agg(F.count("*").alias("n"), F.max("area").alias("largest"))


@query(f"""
    WITH a AS (SELECT {AREA} AS area FROM v_labels), s AS (SELECT min(area) AS low, max(area) AS high FROM a),
         c AS (SELECT CAST(least(floor((area - low) / ((high - low) / 50)), 49) AS INT) AS bin, count(*) AS n FROM a, s GROUP BY 1)
    SELECT CAST(g.bin AS INT) AS bin, low + g.bin * ((high - low) / 50) AS from_area, coalesce(c.n, 0) AS n
    FROM (SELECT unnest(range(50)) AS bin) g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def label_area_histogram(spark, d):
    """F5."""
    return areas.histogram(labels_with_area(spark, d), "area")


@query(f"""
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, {AREA} AS area FROM v_labels
    ORDER BY {AREA}, image_id, l_partkey, l_suppkey, l_linenumber, price LIMIT 20""")
def labels_smallest_k(spark, d):
    """H1: a top-k report."""
    out = areas.smallest(labels_with_area(spark, d), "area", 20, ["image_id", *KEY])
    return out.select("image_id", "l_partkey", "l_suppkey", "l_linenumber", "area")


@query(f"""
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, {AREA} AS area FROM v_labels
    ORDER BY abs({AREA} - 777), image_id, l_partkey, l_suppkey, l_linenumber, price LIMIT 1""")
def label_closest_to_area(spark, d):
    """H2."""
    out = areas.closest(labels_with_area(spark, d), "area", 777, ["image_id", *KEY])
    return out.select("image_id", "l_partkey", "l_suppkey", "l_linenumber", "area")


@query(f"""
    SELECT target, image_id, l_partkey, l_suppkey, l_linenumber, area FROM (
      SELECT t.target, l.image_id, l_partkey, l_suppkey, l_linenumber, {AREA} AS area, row_number() OVER (PARTITION BY t.target
             ORDER BY abs({AREA} - t.target), l.image_id, l_partkey, l_suppkey, l_linenumber, price) AS rn
      FROM v_labels l CROSS JOIN (SELECT unnest([150.0, 400.0, 900.0, 2500.0]) :: DOUBLE AS target) t) WHERE rn = 1""")
def labels_closest_multi(spark, d):
    """H3."""
    targets = spark.createDataFrame([(150.0,), (400.0,), (900.0,), (2500.0,)], "target double")
    out = areas.closest_to_each(labels_with_area(spark, d), "area", targets, ["image_id", *KEY])
    return out.select("target", "image_id", "l_partkey", "l_suppkey", "l_linenumber", "area")


@query("""
    SELECT vec_id, round(0.5 * abs(list_sum(list_transform(range(0, 32), lambda i:
      CAST(embedding[2 * i + 1] AS DOUBLE) * CAST(embedding[2 * ((i + 31) % 32) + 2] AS DOUBLE)
      - CAST(embedding[2 * i + 2] AS DOUBLE) * CAST(embedding[2 * ((i + 31) % 32) + 1] AS DOUBLE)))), 5) AS area
    FROM embeddings""")
def polygon_area_embeddings(spark, d):
    """I30 over polygons of 32 points."""
    coords = F.transform("embedding", lambda c: c.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(G.polygon_area(coords), 5).alias("area"))


@query("""
    SELECT vec_id, list_min(list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 1] AS DOUBLE))) AS x1,
           list_min(list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 2] AS DOUBLE))) AS y1,
           list_max(list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 1] AS DOUBLE))) AS x2,
           list_max(list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 2] AS DOUBLE))) AS y2
    FROM embeddings""")
def polygon_bbox_embeddings(spark, d):
    """I33."""
    box = G.bbox(F.transform("embedding", lambda c: c.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", box.alias("b")).select("vec_id", "b.*")


@query("""
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, round((x1 + x2) / 2, 4) AS cx, round((y1 + y2) / 2, 4) AS cy,
           CASE WHEN x2 < 700 AND y2 < 500 THEN TRUE ELSE FALSE END AS inner_part FROM v_labels""")
def label_centroids(spark, d):
    """I44, C16."""
    v = view(spark, d, "v_labels")
    c = G.centroid(G.box_polygon(*(F.col(x) for x in ("x1", "y1", "x2", "y2"))))
    rows = v.select("image_id", *KEY, "x2", "y2", c.alias("c"))
    return rows.select(
        "image_id", *KEY, F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"),
        ((F.col("x2") < 700) & (F.col("y2") < 500)).alias("inner_part"),
    )


# ---- names and counts --------------------------------------------------------------------------------------------

_P1, _P2 = N.SPECIMEN, N.DASHED


def _pick(a: int, b: str, kind: str = "VARCHAR") -> str:
    return (
        f"CAST(CASE WHEN regexp_matches(filename, '{_P1}') THEN regexp_extract(filename, '{_P1}', {a})"
        f" WHEN regexp_matches(filename, '{_P2}') THEN {b} END AS {kind})"
    )


def _two(i: int) -> str:
    return f"regexp_extract(filename, '{_P2}', {i})"


PARSED = f"""SELECT o_orderkey, filename, {_pick(1, "'aspa'")} AS species, {_pick(2, f"concat('room_', {_two(2)})")} AS room,
    {_pick(3, _two(6))} AS date, {_pick(4, "'1'", "INT")} AS week, {_pick(5, _two(4), "INT")} AS tile,
    {_pick(6, _two(1), "INT")} AS index, {_pick(7, _two(8))} AS extension FROM v_files"""


def files(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "v_files")
    return v.select("*", *[c.alias(k) for k, c in N.parse(F.col("filename")).items()])


@query(PARSED)
def filename_parse(spark, d):
    """I1, I2."""
    return files(spark, d)


@query(f"SELECT o_orderkey, filename FROM v_files WHERE NOT regexp_matches(filename, '{_P1}') AND NOT regexp_matches(filename, '{_P2}')")
def filename_malformed(spark, d):
    """I3."""
    return view(spark, d, "v_files").where(N.malformed(F.col("filename")))


@query(f"""
    WITH p AS ({PARSED} WHERE regexp_matches(filename, '{_P1}') OR regexp_matches(filename, '{_P2}'))
    SELECT CASE WHEN grouping(species) = 0 THEN 'species' WHEN grouping(room) = 0 THEN 'room' WHEN grouping(week) = 0 THEN 'week' ELSE 'tile' END AS field,
           coalesce(species, room, CAST(week AS VARCHAR), CAST(tile AS VARCHAR)) AS value, count(*) AS n
    FROM p GROUP BY GROUPING SETS ((species), (room), (week), (tile))""")
def count_by_field_sets(spark, d):
    """F1, F2 in one pass."""
    rows = files(spark, d).where(~N.malformed(F.col("filename")))
    return counting.count_by_fields(rows, ["species", "room", "week", "tile"])


@query("""
    SELECT image_id, concat('data/images/', dataset, '/', CAST(image_id AS VARCHAR), '.jpg') AS image_path,
           concat('data/labels/', dataset, '/', CAST(image_id AS VARCHAR), '.txt') AS label_path, 'data' AS first_part,
           concat(CAST(image_id AS VARCHAR), '_', CASE WHEN width < 1000 THEN lpad(CAST(width AS VARCHAR), 4, '0') ELSE CAST(width AS VARCHAR) END,
                  '_', CASE WHEN height < 1000 THEN lpad(CAST(height AS VARCHAR), 4, '0') ELSE CAST(height AS VARCHAR) END) AS tile
    FROM v_images""")
def path_rewrites(spark, d):
    """I4 to I8: label paths, data set, stems, padded tile names."""
    v = view(spark, d, "v_images")
    path = F.concat(F.lit("data/images/"), "dataset", F.lit("/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    rows = v.select("image_id", "width", "height", path.alias("image_path"))
    p = F.col("image_path")
    return rows.select(
        "image_id", "image_path", N.label_path(p).alias("label_path"), N.dataset_name(p, "before_images").alias("first_part"),
        N.tile_name(N.stem(p), F.col("width"), F.col("height")).alias("tile"),
    )


@query("SELECT state, count(*) AS n FROM v_state GROUP BY state")
def image_label_state(spark, d):
    """Label files by size, missing ones included."""
    docs, found = table(spark, d, "documents"), table(spark, d, "labels")
    sized = found.select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("length"))
    return counting.state_of(docs.select("doc_id"), sized, "doc_id").groupBy("state").agg(F.count("*").alias("n"))


@query("""
    SELECT CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS level,
           coalesce(dataset, split, 'all') AS name, count(*) AS total, count(*) FILTER (state = 'non_empty') AS non_empty,
           count(*) FILTER (state = 'empty') AS empty,
           CASE WHEN count(*) FILTER (state = 'non_empty') > 0 AND count(*) FILTER (state = 'empty') > 0
                THEN 2 * least(count(*) FILTER (state = 'non_empty'), count(*) FILTER (state = 'empty'))
                ELSE greatest(count(*) FILTER (state = 'non_empty'), count(*) FILTER (state = 'empty')) END AS balanced
    FROM v_state GROUP BY GROUPING SETS ((dataset), (split), ())""")
def balance_stats(spark, d):
    """F8."""
    return counting.balance(view(spark, d, "v_state"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY split, state ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id) AS rn,
                      count(*) FILTER (state = 'non_empty') OVER (PARTITION BY split) AS ne,
                      count(*) FILTER (state = 'empty') OVER (PARTITION BY split) AS em
               FROM v_state WHERE state IN ('non_empty', 'empty'))
    SELECT image_id, dataset, split, state FROM r WHERE ne > 0 AND rn <= CASE WHEN em = 0 THEN ne ELSE least(ne, em) END""")
def balance_sample(spark, d):
    """K14, G5."""
    return counting.balance_sample(view(spark, d, "v_state"), "image_id", 42)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 3 AND (i - 3) % 10 = 0")
def sample_every_nth(spark, d):
    """A sampling operator."""
    return counting.every_nth(table(spark, d, "documents").select("doc_id"), "doc_id", 10, 3)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents) WHERE rn <= 100")
def seeded_sample(spark, d):
    """A sampling operator."""
    return counting.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query("""
    WITH n AS (SELECT count(*) AS n FROM v_state WHERE state = 'non_empty'),
         e AS (SELECT image_id, dataset, split, state, row_number() OVER (ORDER BY image_id) AS rn FROM v_state WHERE state = 'empty')
    SELECT image_id, dataset, split, state FROM v_state WHERE state = 'non_empty'
    UNION ALL SELECT image_id, dataset, split, state FROM e, n WHERE rn <= n""")
def first_k_negatives(spark, d):
    """G7."""
    return counting.first_negatives(view(spark, d, "v_state"), "image_id")


@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('1:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents)
    SELECT doc_id, CASE WHEN rn <= 15 THEN 'val' WHEN rn <= 30 THEN 'test'
                        ELSE concat('train_', CAST(((rn - 31) // 10) * 10 + 10 AS VARCHAR)) END AS bucket
    FROM r WHERE rn - 30 <= 100""")
def bucketed_split(spark, d):
    """A sampling operator."""
    return counting.nested_buckets(table(spark, d, "documents").select("doc_id"), "doc_id", 1)


@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS rn,
                      count(*) OVER () - 3 AS m FROM documents)
    SELECT doc_id, CASE WHEN rn = 1 THEN 'train' WHEN rn = 2 THEN 'val' WHEN rn = 3 THEN 'test'
                        WHEN rn - 3 <= floor(m * 0.7) THEN 'train' WHEN rn - 3 <= floor(m * 0.7) + floor(m * 0.15) THEN 'val'
                        ELSE 'test' END AS split FROM r""")
def random_split_guaranteed(spark, d):
    """K10."""
    return splitting.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")


def _greedy_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    on = f"o.{by} = w.{by} AND " if by else ""
    return f"""
    WITH RECURSIVE c AS (SELECT {keys}value, count(*) AS n FROM v_groups GROUP BY {keys}value),
      o AS (SELECT *, row_number() OVER ({part} ORDER BY n DESC, value) AS i, CAST(sum(n) OVER ({part}) AS DOUBLE) AS total FROM c),
      w AS (SELECT {keys}value, n, i, CAST('train' AS VARCHAR) AS split, CAST(n AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM o WHERE i = 1
        UNION ALL
        SELECT {"o." + by + ", " if by else ""}o.value, o.n, o.i, s.split, w.a + CASE WHEN s.split = 'train' THEN o.n ELSE 0 END,
               w.b + CASE WHEN s.split = 'val' THEN o.n ELSE 0 END, w.c + CASE WHEN s.split = 'test' THEN o.n ELSE 0 END
        FROM w JOIN o ON {on}o.i = w.i + 1,
        LATERAL (SELECT 0.8 :: DOUBLE * abs((w.a + o.n) / greatest(1.0 :: DOUBLE, o.total * 0.7 :: DOUBLE) - 1) AS ga,
                        0.9 :: DOUBLE * abs((w.b + o.n) / greatest(1.0 :: DOUBLE, o.total * 0.15 :: DOUBLE) - 1) AS gb,
                        1.0 :: DOUBLE * abs((w.c + o.n) / greatest(1.0 :: DOUBLE, o.total * 0.15 :: DOUBLE) - 1) AS gc) g,
        LATERAL (SELECT CASE WHEN o.i = 2 THEN 'val' WHEN o.i = 3 THEN 'test' WHEN ga = least(ga, gb, gc) THEN 'train'
                             WHEN gb = least(ga, gb, gc) THEN 'val' ELSE 'test' END AS split) s)
    """


@query(_greedy_sql("") + "SELECT value, n, split FROM w")
def greedy_group_split(spark, d):
    """K2, K3: nations to splits."""
    return splitting.greedy_groups(splitting.group_counts(view(spark, d, "v_groups"), "value"), "value")


@query(_greedy_sql("stratum") + "SELECT value, max_by(split, stratum) AS split FROM w GROUP BY value")
def stratified_group_split(spark, d):
    """By segment; later segments overwrite earlier ones."""
    counts = splitting.group_counts(view(spark, d, "v_groups"), "value", ["stratum"])
    return splitting.last_stratum(splitting.greedy_groups(counts, "value", by=["stratum"]), "value", "stratum")


@query(_greedy_sql("") + """, s AS (SELECT split, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY split), t AS (SELECT sum(n) AS total FROM s)
    SELECT split, n, round(100.0 * n / total, 6) AS pct,
           round(abs(n - total * CASE split WHEN 'train' THEN 0.7 :: DOUBLE ELSE 0.15 :: DOUBLE END), 6) AS deviation FROM s, t""")
def split_deviation(spark, d):
    """F9, F10, D16."""
    v = view(spark, d, "v_groups")
    chosen = splitting.greedy_groups(splitting.group_counts(v, "value"), "value")
    return splitting.split_counts(splitting.assign_groups(v, chosen, "value"))


@query()
def ilp_split_objective(spark, d):
    """K1: the exact assignment's deviation; groups are the nations."""
    counts = [(r[0], r[1]) for r in splitting.group_counts(view(spark, d, "v_groups"), "value").collect()]
    chosen, objective = splitting.exact_groups(counts)
    return spark.createDataFrame([(len(chosen), round(objective, 6))], "n_groups int, objective double")


# ---- tiles -------------------------------------------------------------------------------------------------------

_TILES = """SELECT image_id, CAST(i * 320 AS INT) AS x0, CAST(i * 320 + 640 AS INT) AS x1, CAST(j * 320 AS INT) AS y0, CAST(j * 320 + 640 AS INT) AS y1
    FROM v_images, LATERAL (SELECT unnest(range((width - 320) // 320)) AS i) a, LATERAL (SELECT unnest(range((height - 320) // 320)) AS j) b"""


@query(_TILES)
def tile_grid(spark, d):
    """J1."""
    return tiling.tiles(view(spark, d, "v_images"))


@query("SELECT image_id, (width + 319) // 320 AS nx, (height + 319) // 320 AS ny, ((width + 319) // 320) * ((height + 319) // 320) AS n FROM v_images")
def tile_estimate(spark, d):
    """J2."""
    return tiling.tile_estimate(view(spark, d, "v_images"))


@query("""
    WITH RECURSIVE r AS (SELECT image_id, dataset, ((width + 319) // 320) * ((height + 319) // 320) AS n,
      row_number() OVER (PARTITION BY dataset ORDER BY image_id) AS pos FROM v_images),
    walk AS (SELECT image_id, dataset, n, pos, n AS held, CASE WHEN n >= 1500 THEN 1 ELSE 0 END AS folder FROM r WHERE pos = 1
      UNION ALL
      SELECT r.image_id, r.dataset, r.n, r.pos, CASE WHEN held + r.n >= 1500 THEN r.n ELSE held + r.n END,
        folder + CASE WHEN held + r.n >= 1500 THEN 1 ELSE 0 END
      FROM walk JOIN r ON r.dataset = walk.dataset AND r.pos = walk.pos + 1)
    SELECT image_id, dataset, n, CAST(folder AS BIGINT) AS folder FROM walk""")
def tile_rollover(spark, d):
    """The counter starts anew in each folder. (The limit is below the default of 16382 files, so that small tables fill folders too.)"""
    est = tiling.tile_estimate(view(spark, d, "v_images")).select("image_id", "n")
    rows = view(spark, d, "v_images").select("image_id", "dataset").join(est, "image_id")
    return areas.reset_groups(rows, "n", "image_id", 1500, ["dataset"])


@query("""
    SELECT image_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, c * (width // 3) AS x0, r * (height // 3) AS y0,
           (c + 1) * (width // 3) AS x1, (r + 1) * (height // 3) AS y1
    FROM v_images, (SELECT unnest(range(3)) AS r) a, (SELECT unnest(range(3)) AS c) b""")
def segment_grid(spark, d):
    """J3."""
    return tiling.segments(view(spark, d, "v_images"))


_IN_TILES = f"""
    t AS ({_TILES}), o AS (
      SELECT l.image_id, l_partkey, l_suppkey, l_linenumber, price, l.class_id, t.x0 AS tx, t.y0 AS ty,
             greatest(l.x1, t.x0) AS cx1, greatest(l.y1, t.y0) AS cy1, least(l.x2, t.x1) AS cx2, least(l.y2, t.y1) AS cy2,
             (l.x2 - l.x1) * (l.y2 - l.y1) AS area
      FROM v_labels l JOIN t ON l.image_id = t.image_id AND l.x1 < t.x1 AND l.x2 > t.x0 AND l.y1 < t.y1 AND l.y2 > t.y0),
    k AS (SELECT *, (cx2 - cx1) * (cy2 - cy1) AS inside FROM o),
    q AS (SELECT * FROM k WHERE inside > 0.5 * area OR (inside >= 20 AND inside >= 0.1 * area))"""


@query(f"WITH {_IN_TILES} SELECT image_id, tx, ty, class_id, count(*) AS n, round(sum(inside), 3) AS inside FROM q GROUP BY image_id, tx, ty, class_id")
def tile_assignment(spark, d):
    """D9, K7, K9."""
    rows = tiling.tile_boxes(view(spark, d, "v_labels"), view(spark, d, "v_images"))
    inside = (F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1"))
    return rows.groupBy("image_id", "tx", "ty", "class_id").agg(F.count("*").alias("n"), F.round(F.sum(inside), 3).alias("inside"))


@query(f"""WITH {_IN_TILES} SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, class_id, tx, ty, round((cx1 - tx) / 640, 8) AS nx1,
    round((cy1 - ty) / 640, 8) AS ny1, round((cx2 - tx) / 640, 8) AS nx2, round((cy2 - ty) / 640, 8) AS ny2 FROM q""")
def tile_labels_renormalised(spark, d):
    """J5, I34, I35 for boxes."""
    rows = tiling.tile_boxes(view(spark, d, "v_labels"), view(spark, d, "v_images"))
    cut = [F.round(c, 8).alias(c) for c in ("nx1", "ny1", "nx2", "ny2")]
    return rows.select("image_id", *KEY, "class_id", "tx", "ty", *cut)


# ---- evaluation --------------------------------------------------------------------------------------------------

_ID = "concat_ws('-', {0}l_partkey, {0}l_suppkey, {0}l_linenumber, {0}price)"
_CAND = """
    c AS (SELECT g.image_id, g.class_id, concat_ws('-', g.l_partkey, g.l_suppkey, g.l_linenumber) AS gt,
                 concat_ws('-', p.l_partkey, p.l_suppkey, p.l_linenumber) AS pred,
                 (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i,
                 (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa
          FROM v_labels g JOIN v_preds p ON g.image_id = p.image_id AND g.class_id = p.class_id
               AND g.x1 < p.x2 AND p.x1 < g.x2 AND g.y1 < p.y2 AND p.y1 < g.y2)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")
    return view(spark, d, "v_labels").select("image_id", "class_id", "x1", "y1", "x2", "y2", key.alias("gt_id"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")
    return view(spark, d, "v_preds").select("image_id", "class_id", "x1", "y1", "x2", "y2", "conf", key.alias("pred_id"))


def candidates(spark: SparkSession, d: str, same_class: bool = True) -> DataFrame:
    found = matching.iou_candidates(truth(spark, d), predictions(spark, d), same_class)
    return found.select("image_id", F.col("gt.gt_id").alias("gt_id"), F.col("pred.pred_id").alias("pred_id"), F.round("iou", 9).alias("iou"))


@query(f"WITH {_CAND} SELECT image_id, gt AS gt_id, pred AS pred_id, round(i / (ga + pa - i), 9) AS iou FROM c WHERE round(i / (ga + pa - i), 9) > 0")
def bbox_iou_candidates(spark, d):
    """D10, I37."""
    return candidates(spark, d)


@query()
def greedy_match_pairs(spark, d):
    """K4: tested against a plain loop."""
    return matching.greedy_match(candidates(spark, d), "gt_id", "pred_id")


@query(f"""WITH {_CAND}, r AS (SELECT image_id, pred AS pred_id, gt AS gt_id, round(i / (ga + pa - i), 9) AS iou FROM c),
    q AS (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS rn FROM r)
    SELECT image_id, pred_id, gt_id, iou FROM q WHERE rn = 1""")
def best_iou_match(spark, d):
    """D12."""
    return matching.best_by_iou(candidates(spark, d), "pred_id", "gt_id")


@query(f"""WITH {_CAND}, m AS (SELECT image_id, count(DISTINCT gt) AS gm, count(DISTINCT pred) AS pm FROM c WHERE round(i / (ga + pa - i), 9) >= 0.5 GROUP BY image_id),
    g AS (SELECT image_id, count(*) AS ng FROM v_labels GROUP BY image_id), p AS (SELECT image_id, count(*) AS np FROM v_preds GROUP BY image_id),
    a AS (SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np FROM g FULL JOIN p ON g.image_id = p.image_id)
    SELECT a.image_id, CASE WHEN np <> ng THEN np > ng ELSE coalesce(pm, 0) < np END AS has_fp,
           CASE WHEN np <> ng THEN np < ng ELSE coalesce(gm, 0) < ng END AS has_fn FROM a LEFT JOIN m ON a.image_id = m.image_id""")
def image_fp_fn_flags(spark, d):
    """K13, D11."""
    return matching.image_flags(truth(spark, d), predictions(spark, d), candidates(spark, d), "gt_id", "pred_id")


@query("""WITH p AS (SELECT class_id, conf, CASE WHEN x1 < 5000 AND l_partkey % 17 <> 0 THEN 1 ELSE 0 END AS tp FROM v_preds),
    s AS (SELECT class_id, conf, sum(tp) AS tp, count(*) AS np FROM p GROUP BY class_id, conf),
    u AS (SELECT *, sum(tp) OVER w / sum(np) OVER w AS pr FROM s WINDOW w AS (PARTITION BY class_id ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, max(pr) OVER (PARTITION BY class_id ORDER BY conf DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM u),
    n AS (SELECT class_id, count(*) AS n FROM v_labels GROUP BY class_id)
    SELECT n.class_id, round(sum(tp * env) / min(n.n), 6) AS ap FROM n JOIN e ON e.class_id = n.class_id GROUP BY n.class_id""")
def average_precision_50(spark, d):
    """L5."""
    p = view(spark, d, "v_preds").select("class_id", "conf", ((F.col("x1") < 5000) & (F.col("l_partkey") % 17 != 0)).alias("tp"))
    return matching.average_precision(p, view(spark, d, "v_labels").groupBy("class_id").agg(F.count("*").alias("n")))


_CM = """m AS (SELECT t.l AS true_label, p.l AS pred_label, (SELECT count(*) FROM v_pairs v WHERE v.true_label = t.l AND v.pred_label = p.l) AS n
    FROM (SELECT unnest(range(4)) :: INT AS l) t, (SELECT unnest(range(4)) :: INT AS l) p)"""


@query(f"WITH {_CM} SELECT * FROM m")
def confusion_matrix(spark, d):
    """F14, E4."""
    return metrics.confusion_matrix(view(spark, d, "v_pairs"))


@query(f"WITH {_CM} SELECT *, round(n / greatest(sum(n) OVER (PARTITION BY true_label), 1), 6) AS share FROM m")
def confusion_normalised(spark, d):
    """F20, F24."""
    return metrics.normalised(metrics.confusion_matrix(view(spark, d, "v_pairs")), "true")


@query("""SELECT CASE WHEN true_label = pred_label THEN 'TP' WHEN pred_label = 3 THEN 'FN' ELSE 'misclassified' END AS outcome, count(*) AS n
    FROM v_pairs GROUP BY 1""")
def result_types(spark, d):
    """F15, F21."""
    return metrics.outcome_counts(view(spark, d, "v_pairs"))


_CC = """k AS (SELECT c AS class_id, CAST(count(*) FILTER (true_label = c AND pred_label = c) AS BIGINT) AS tp,
    CAST(count(*) FILTER (true_label <> c AND pred_label = c) AS BIGINT) AS fp, CAST(count(*) FILTER (true_label = c AND pred_label <> c) AS BIGINT) AS fn,
    CAST(count(*) FILTER (true_label <> c AND pred_label <> c) AS BIGINT) AS tn FROM v_pairs, (SELECT unnest(range(3)) :: INT AS c) u GROUP BY c)"""
_RATIOS = "tp / (tp + fp) AS p, tp / (tp + fn) AS r, (tp + tn) / (tp + fp + fn + tn) AS accuracy"


@query(f"""WITH {_CC}, x AS (SELECT *, {_RATIOS} FROM k)
    SELECT class_id, tp, fp, fn, tn, round(p, 3) AS precision, round(r, 3) AS recall, round(2 * p * r / (p + r), 3) AS f1, round(accuracy, 3) AS accuracy FROM x""")
def class_metrics(spark, d):
    """F17."""
    return metrics.class_metrics(view(spark, d, "v_pairs"), [0, 1, 2])


@query(f"""WITH {_CC}, x AS (SELECT *, {_RATIOS} FROM k), y AS (SELECT *, 2 * p * r / (p + r) AS f FROM x),
    s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) // 3 AS BIGINT) AS tn,
          avg(p) AS p, avg(r) AS r, avg(f) AS f, avg(accuracy) AS a FROM y)
    SELECT 'macro' AS kind, tp, fp, fn, tn, round(p, 3) AS precision, round(r, 3) AS recall, round(f, 3) AS f1, round(a, 3) AS accuracy FROM s
    UNION ALL SELECT 'micro', tp, fp, fn, tn, round(tp / (tp + fp), 3), round(tp / (tp + fn), 3),
    round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3), round((tp + tn) / (tp + fp + fn + tn), 3) FROM s""")
def macro_micro_metrics(spark, d):
    """F18, F19."""
    return metrics.averages(view(spark, d, "v_pairs"), [0, 1, 2])


@query(f"""WITH {_CM}, a AS (SELECT true_label AS l, sum(n) AS row, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS dd FROM m GROUP BY 1),
    b AS (SELECT pred_label AS l, sum(n) AS col FROM m GROUP BY 1), s AS (SELECT sum(n) AS s FROM m),
    r AS (SELECT dd AS tp, row - dd AS fp, col - dd AS fn, s - row - col + dd AS tn FROM a JOIN b ON a.l = b.l, s WHERE a.l <> 3),
    e AS (SELECT CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS tpr, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS fnr,
          CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 0 END AS tnr,
          CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p FROM r)
    SELECT round(avg(tpr), 6) AS tpr, round(avg(fnr), 6) AS fnr, round(avg(fpr), 6) AS fpr, round(avg(tnr), 6) AS tnr, round(avg(p), 6) AS precision,
           round(avg(tpr), 6) AS recall, round(avg(CASE WHEN p + tpr > 0 THEN 2 * p * tpr / (p + tpr) ELSE 0 END), 6) AS f1 FROM e""")
def rates_from_matrix(spark, d):
    """F22, F23."""
    return metrics.matrix_rates(metrics.confusion_matrix(view(spark, d, "v_pairs")), [3])


@query("""SELECT l AS label, CAST((SELECT count(*) FROM v_pairs WHERE true_label = l) AS BIGINT) AS n_true,
    CAST((SELECT count(*) FROM v_pairs WHERE pred_label = l) AS BIGINT) AS n_pred FROM (SELECT unnest(range(4)) :: INT AS l) t""")
def class_distribution(spark, d):
    """F16."""
    return metrics.class_distribution(view(spark, d, "v_pairs"), [0, 1, 2])


# ---- COCO --------------------------------------------------------------------------------------------------------


def annotations(spark: SparkSession, d: str, side: str) -> DataFrame:
    v = view(spark, d, f"v_coco_anns_{side}")
    box = F.when(F.col("no_box"), F.array().cast("array<double>")).otherwise(F.array("x1", "y1", "w", "h"))
    ring = G.box_polygon(F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h"))
    seg = F.when(F.col("no_segments"), F.array().cast("array<array<double>>")).otherwise(F.array(ring))
    return v.select("id", "image_id", F.col("category_id").cast("long").alias("category_id"), box.alias("bbox"), seg.alias("segmentation"), "price")


@query("SELECT id, image_id, CAST(category_id AS BIGINT) AS category_id, w * h AS area, price FROM v_coco_anns_base WHERE NOT no_box AND NOT no_segments")
def coco_fix(spark, d):
    """C9 to C11."""
    rows = coco.with_extent(coco.repair(annotations(spark, d, "base"))).where(coco.all_parts(F.col("segmentation")))
    return rows.select("id", "image_id", "category_id", (F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3))).alias("area"), "price")


@query("""SELECT count(*) AS total, count(*) FILTER (NOT no_box AND NOT no_segments) AS valid,
    count(*) FILTER (no_box OR no_segments) AS invalid FROM v_coco_anns_base""")
def coco_stats(spark, d):
    """F27."""
    return coco.validity(annotations(spark, d, "base"))


@query("""SELECT 'images' AS part, count(*) AS n FROM v_coco_images_base UNION ALL SELECT 'annotations', count(*) FROM v_coco_anns_base
    UNION ALL SELECT 'categories', count(*) FROM v_coco_cats_base""")
def coco_sizes(spark, d):
    """F26."""
    return coco.statistics(*(view(spark, d, f"v_coco_{x}_base") for x in ("images", "anns", "cats")))


_CATS = """u AS (SELECT name, id AS base_id, NULL AS extra_id, 0 AS side, id AS o FROM v_coco_cats_base
    UNION ALL SELECT name, NULL, id, 1, id FROM v_coco_cats_add), y AS (SELECT name, max(base_id) AS base_id, max(extra_id) AS extra_id,
    min(side * 1000 + o) AS f FROM u GROUP BY name), cats AS (SELECT row_number() OVER (ORDER BY f) AS id, name,
    CAST(base_id AS BIGINT) AS base_id, CAST(extra_id AS BIGINT) AS extra_id FROM y)"""


def categories(spark: SparkSession, d: str) -> DataFrame:
    base, extra = (view(spark, d, f"v_coco_cats_{x}").withColumn("id", F.col("id").cast("long")) for x in ("base", "add"))
    return coco.merge_categories(base, extra)


@query(f"WITH {_CATS} SELECT id, name, base_id, extra_id FROM cats")
def coco_categories(spark, d):
    """D7, G2, F33."""
    return categories(spark, d)


@query(f"""WITH {_CATS}, cm AS (SELECT b.id AS own, a.id AS ext FROM v_coco_images_base b JOIN v_coco_images_add a
      ON regexp_extract(b.file_name, '[^/]*$') = regexp_extract(a.file_name, '[^/]*$')),
    th AS (SELECT x.id, cm.own AS image_id, cats.id AS category_id, x.price, 'extra' AS side FROM v_coco_anns_add x JOIN cm ON x.image_id = cm.ext JOIN cats ON cats.extra_id = x.category_id),
    ow AS (SELECT x.id, x.image_id, cats.id AS category_id, x.price, 'base' AS side FROM v_coco_anns_base x JOIN v_coco_images_base b ON x.image_id = b.id
      JOIN cats ON cats.base_id = x.category_id WHERE x.image_id NOT IN (SELECT image_id FROM th)),
    al AS (SELECT * FROM th UNION ALL SELECT * FROM ow)
    SELECT row_number() OVER (ORDER BY image_id, id) AS new_id, image_id, id, category_id, side FROM al""")
def coco_merge(spark, d):
    """D6, D8, E2, G1."""
    merged = coco.merge(
        view(spark, d, "v_coco_images_base"), annotations(spark, d, "base"), view(spark, d, "v_coco_images_add"),
        annotations(spark, d, "add"), categories(spark, d),
    )
    return merged.select("new_id", "image_id", "id", "category_id", "side")


@query("""SELECT doc_id, 'b' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'a' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missing_pairs(spark, d):
    """D3, D4, E1, E3."""
    return counting.only_in_one(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


# ---- boxes, relabelling, run lengths ------------------------------------------------------------------------------


@query("""SELECT l.image_id, l_partkey, l_suppkey, l_linenumber, price, CAST(r AS INT) AS row, CAST(c AS INT) AS col
    FROM v_labels l JOIN v_images i ON l.image_id = i.image_id, (SELECT unnest(range(3)) AS r) a, (SELECT unnest(range(3)) AS c) b
    WHERE x1 >= c * (width // 3) AND y1 >= r * (height // 3) AND x2 <= (c + 1) * (width // 3) AND y2 <= (r + 1) * (height // 3)""")
def roi_containment(spark, d):
    """C16, D14."""
    labels = view(spark, d, "v_labels").select("image_id", *KEY, "x1", "y1", "x2", "y2")
    found = boxes.in_own_windows(labels, view(spark, d, "v_images"), lambda rows, keep: tiling.segments(rows, keep=keep))
    return found.select("image_id", *KEY, F.col("w_row").alias("row"), F.col("w_col").alias("col"))


@query("""SELECT p_partkey, p_brand, coalesce(CAST((SELECT min_by(s_suppkey, s_suppkey) FROM supplier WHERE s_nationkey = p_size) AS VARCHAR), 'Not Found') AS s_suppkey
    FROM part""")
def roi_class_lookup(spark, d):
    """D5, A15."""
    master = table(spark, d, "supplier").select(F.col("s_nationkey").alias("p_size"), "s_suppkey")
    found = boxes.class_lookup(table(spark, d, "part"), master, "p_size", "s_suppkey", "s_suppkey")
    return found.select("p_partkey", "p_brand", "s_suppkey")


@query("""WITH b AS (SELECT image_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS k, x1, y1, x2, y2 FROM v_labels)
    SELECT p.image_id, p.k AS a, q.k AS b FROM b p JOIN b q ON p.image_id = q.image_id AND p.k < q.k
      AND p.x1 <= q.x2 AND q.x1 <= p.x2 AND p.y1 <= q.y2 AND q.y1 <= p.y2""")
def box_overlap_pairs(spark, d):
    """C17, D13."""
    return boxes.overlapping_pairs(truth(spark, d), "gt_id")


@query("""WITH b AS (SELECT image_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS k, x1, y1, x2, y2 FROM v_labels)
    SELECT image_id, k AS gt_id FROM b p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE p.image_id = q.image_id AND p.k <> q.k
      AND p.x1 < q.x2 AND q.x1 < p.x2 AND p.y1 < q.y2 AND q.y1 < p.y2
      AND (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1)) >= 0.3)""")
def low_overlap_boxes(spark, d):
    """C24, D18."""
    t = truth(spark, d)
    return boxes.low_overlap(t, t, "gt_id")


@query()
def merged_boxes(spark, d):
    """K5: overlapping boxes joined; tested against a plain loop."""
    p = predictions(spark, d).drop("pred_id")
    return matching.merge_boxes(p)


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1 ELSE 0 END) AS x FROM embeddings),
    e AS (SELECT vec_id, list_filter(range(0, 65), lambda i: i = 64 OR x[i + 1] <> CASE WHEN i = 0 THEN 0 ELSE x[i] END) AS p FROM b)
    SELECT vec_id, array_to_string(list_transform(range(1, len(p) + 1), lambda j: p[j] - CASE WHEN j = 1 THEN 0 ELSE p[j - 1] END), ',') AS rle FROM e""")
def rle_encode(spark, d):
    """I52."""
    bits = F.transform("embedding", lambda e: F.when(e > 0, 1).otherwise(0))
    rows = table(spark, d, "embeddings").select("vec_id", bits.alias("bits"))
    return rows.select("vec_id", F.array_join(rle.encode(F.col("bits")).cast("array<string>"), ",").alias("rle"))


@query("SELECT vec_id, TRUE AS same, CAST(len(list_filter(embedding, lambda e: e > 0)) AS INT) AS ones FROM embeddings")
def rle_roundtrip(spark, d):
    """I53."""
    bits = F.transform("embedding", lambda e: F.when(e > 0, 1).otherwise(0))
    rows = table(spark, d, "embeddings").select("vec_id", bits.alias("bits"))
    back = rows.select("vec_id", "bits", rle.decode(rle.encode(F.col("bits"))).alias("back"))
    return back.select("vec_id", (F.col("bits") == F.col("back")).alias("same"), F.size(F.filter("back", lambda b: b == 1)).alias("ones"))


@query("SELECT CASE class_id WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE class_id END AS class_id, count(*) AS n FROM v_labels GROUP BY 1")
def relabel_map(spark, d):
    """C27."""
    return counting.count_by_field(filters.relabel(view(spark, d, "v_labels"), {0: 2, 1: 3}), "class_id")


@query("""SELECT 'drop' AS rule, CASE class_id WHEN 2 THEN 1 END AS class_id, count(*) AS n FROM v_labels WHERE class_id IN (2) GROUP BY 2
    UNION ALL SELECT 'alive', CASE class_id WHEN 2 THEN 1 ELSE 0 END, count(*) FROM v_labels WHERE class_id IN (0, 2) GROUP BY 2""")
def relabel_drop(spark, d):
    """C28, C29."""
    v = view(spark, d, "v_labels")
    a = counting.count_by_field(filters.relabel(v, {2: 1, 3: 2}, "drop"), "class_id").select(F.lit("drop").alias("rule"), "class_id", "n")
    b = counting.count_by_field(filters.alive_or_dead(v, [0], [2]), "class_id").select(F.lit("alive").alias("rule"), "class_id", "n")
    return a.unionByName(b)


@query("""SELECT l.image_id, l_partkey, l_suppkey, l_linenumber, price, width - x2 AS x1, width - x1 AS x2, y1, y2
    FROM v_labels l JOIN v_images i ON l.image_id = i.image_id""")
def flip_boxes(spark, d):
    """M7."""
    rows = view(spark, d, "v_labels").join(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id")
    return boxes.flip(rows, F.col("width"), F.col("height")).select("image_id", *KEY, "x1", "x2", "y1", "y2")


_LB = "least(640.0 :: DOUBLE / height, 640.0 :: DOUBLE / width)"


@query(f"""WITH r AS (SELECT l.*, width, height, {_LB} AS r FROM v_labels l JOIN v_images i ON l.image_id = i.image_id),
    p AS (SELECT *, round_even((640 - round_even(width * r, 0)) / 2 - 0.1, 0) AS px, round_even((640 - round_even(height * r, 0)) / 2 - 0.1, 0) AS py FROM r)
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, round(x1 * r + px, 6) AS x1, round(y1 * r + py, 6) AS y1,
           round(x2 * r + px, 6) AS x2, round(y2 * r + py, 6) AS y2 FROM p""")
def letterbox_boxes(spark, d):
    """M8."""
    rows = view(spark, d, "v_labels").join(view(spark, d, "v_images").select("image_id", "width", "height"), "image_id")
    out = boxes.letterbox(rows, F.col("width"), F.col("height"))
    return out.select("image_id", *KEY, *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price FROM v_labels
    WHERE (x2 - x1) * 0.2 > 2 AND (y2 - y1) * 0.2 > 2 AND (x2 - x1) * 0.2 * ((y2 - y1) * 0.2) / ((x2 - x1) * (y2 - y1) + 1e-16) > 0.01
      AND greatest((x2 - x1) * 0.2 / ((y2 - y1) * 0.2 + 1e-16), (y2 - y1) * 0.2 / ((x2 - x1) * 0.2 + 1e-16)) < 100""")
def box_candidates(spark, d):
    """C23."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return view(spark, d, "v_labels").where(filters.box_candidates(w, h, w * 0.2, h * 0.2, area_thr=0.01)).select("image_id", *KEY)


@query("""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, least(greatest(x1 + 100, 0), 1280) AS x1, least(greatest(x2 + 100, 0), 1280) AS x2,
    least(greatest(y1 - 50, 0), 720) AS y1, least(greatest(y2 - 50, 0), 720) AS y2 FROM v_labels
    WHERE least(greatest(x1 + 100, 0), 1280) < least(greatest(x2 + 100, 0), 1280) AND least(greatest(y1 - 50, 0), 720) < least(greatest(y2 - 50, 0), 720)""")
def mosaic_boxes(spark, d):
    """M3, J9."""
    out = boxes.mosaic(view(spark, d, "v_labels"), F.lit(100.0), F.lit(-50.0), 1280, 720)
    return out.select("image_id", *KEY, "x1", "x2", "y1", "y2")


# ---- experiments, events -----------------------------------------------------------------------------------------


@query("""SELECT conf, train_size, round(avg(map50), 6) AS mean, round(min(map50), 6) AS least, round(max(map50), 6) AS largest FROM v_results GROUP BY conf, train_size
    UNION ALL SELECT DISTINCT conf, 0, 0.0, 0.0, 0.0 FROM v_results""")
def experiment_curve(spark, d):
    """F12."""
    v = view(spark, d, "v_results").withColumn("conf", F.col("conf").cast("double"))
    return experiments.curve(v, "map50", ["conf", "train_size"], origin=True)


@query("SELECT train_size, round(avg(total_train_time / 60), 6) AS mean, round(min(total_train_time / 60), 6) AS least, round(max(total_train_time / 60), 6) AS largest FROM v_results GROUP BY 1")
def train_time_curve(spark, d):
    """F13, I21."""
    v = view(spark, d, "v_results").withColumn("minutes", experiments.in_unit(F.col("total_train_time"), "minutes"))
    return experiments.curve(v, "minutes", ["train_size"])


@query("""WITH r AS (SELECT run, train_size, epoch, map50, row_number() OVER (PARTITION BY run, train_size ORDER BY epoch) - 1 AS i,
      count(*) OVER (PARTITION BY run, train_size) AS n FROM v_results)
    SELECT run, train_size, max(n) AS n_rows, max(greatest(0, n - 11)) AS best_epoch, max(map50) FILTER (i = greatest(0, n - 11)) AS value_at_best,
           max(map50) FILTER (i = n - 1) AS last_value FROM r GROUP BY run, train_size""")
def best_epoch(spark, d):
    """G14, A19."""
    return experiments.best_epoch(view(spark, d, "v_results"), ["run", "train_size"], "epoch", "map50", 10)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    """I60."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT user_id, event_id, date_diff('week', TIMESTAMP '2000-01-03', ts) AS week,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events""")
def week_navigation(spark, d):
    """G13, H9."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    week = F.floor(F.datediff(F.date_trunc("week", "ts"), F.lit("2000-01-03").cast("date")) / 7)
    return table(spark, d, "events").select("user_id", "event_id", week.alias("week"), F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    """The batch form of the streaming window."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")
    )


# ---- selection, validation, augmentation of labels -----------------------------------------------------------------


@query("""SELECT o_orderkey, dataset FROM (SELECT o_orderkey, o_orderpriority AS dataset, month(o_orderdate) AS m, o_custkey % 20 AS t, o_clerk_s AS s
    FROM (SELECT *, concat('S', CAST(o_custkey % 5 AS STRING)) AS o_clerk_s FROM orders)) WHERE m IN (1, 2, 3) AND t IN (4, 5) AND contains(s, 'S4')""")
def image_selection(spark, d):
    """C8."""
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("dataset"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 20).alias("tile"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("species"),
    )
    return filters.select_images(rows, months=[1, 2, 3], species="S4", tiles=[4, 5]).select("o_orderkey", "dataset")


@query("""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, least(x1, 500) AS x1, least(y1, 400) AS y1, least(x2, 500) AS x2, least(y2, 400) AS y2
    FROM v_labels WHERE least(x1, 500) < least(x2, 500) AND least(y1, 400) < least(y2, 400)""")
def crop_boxes(spark, d):
    """C15."""
    rows = view(spark, d, "v_labels").withColumns({"width": F.lit(500), "height": F.lit(400)})
    return filters.crop_boxes(rows).select("image_id", *KEY, "x1", "y1", "x2", "y2")


@query("""SELECT dataset, CASE WHEN n_images = 0 THEN 'no image exists' WHEN n_labels = 0 THEN 'no label file exists' ELSE '' END AS message,
    n_images > 0 AND n_labels > 0 AS ok FROM (SELECT dataset, count(*) AS n_images, count(*) FILTER (state <> 'missing') AS n_labels FROM v_state GROUP BY dataset)""")
def manifest_validation(spark, d):
    """C18, C19."""
    found = view(spark, d, "v_state").groupBy("dataset").agg(F.count("*").alias("n_images"), F.count_if(F.col("state") != "missing").alias("n_labels"))
    flags = {c: F.lit(True) for c in ("has_manifest", "has_names", "has_path", "has_list")}
    return filters.invalid_manifest(found.withColumns({**flags, "n_listed": F.col("n_images"), "n_bad_paths": F.lit(0)})).select("dataset", "message", "ok")


@query("""SELECT image_id, CAST(i * 900 AS INT) AS x0, CAST(j * 900 AS INT) AS y0, least(i * 900 + 900, width) AS x1, least(j * 900 + 900, height) AS y1
    FROM v_images, LATERAL (SELECT unnest(range((width + 899) // 900)) AS i) a, LATERAL (SELECT unnest(range((height + 899) // 900)) AS j) b""")
def batch_windows(spark, d):
    """J4, J11."""
    return boxes.windows(view(spark, d, "v_images"), 900)


@query("""SELECT doc_id, (rn - 1) // 7 AS row, (rn - 1) % 7 AS col FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)""")
def thumbnail_grid(spark, d):
    """J8."""
    ranks = S.ranked_by_key(table(spark, d, "documents").select("doc_id"), "doc_id", "rn")
    return boxes.thumbnails(ranks, "rn", 7).select("doc_id", "row", "col")


@query("""WITH b AS (SELECT *, least(greatest(0.5 * x1 + 10, 0), 300) AS nx1, least(greatest(0.5 * y1 - 20, 0), 300) AS ny1,
      least(greatest(0.5 * x2 + 10, 0), 300) AS nx2, least(greatest(0.5 * y2 - 20, 0), 300) AS ny2 FROM v_labels)
    SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, nx1, ny1, nx2, ny2 FROM b WHERE nx2 - nx1 > 2 AND ny2 - ny1 > 2
      AND (nx2 - nx1) * (ny2 - ny1) / ((x2 - x1) * (y2 - y1) + 1e-16) > 0.1
      AND greatest((nx2 - nx1) / (ny2 - ny1 + 1e-16), (ny2 - ny1) / (nx2 - nx1 + 1e-16)) < 100""")
def perspective_boxes(spark, d):
    """M5, I46."""
    out = boxes.transform_boxes(view(spark, d, "v_labels"), [[0.5, 0.0, 10.0], [0.0, 0.5, -20.0], [0.0, 0.0, 1.0]], 300, 300)
    return out.select("image_id", *KEY, "nx1", "ny1", "nx2", "ny2")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('5:', CAST(doc_id AS VARCHAR))), doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT a.doc_id, b.doc_id AS partner FROM r a JOIN r b ON a.rn % a.n + 1 = b.rn""")
def mix_partners(spark, d):
    """M2, M4."""
    return boxes.partners(table(spark, d, "documents"), "doc_id", 5)


@query("""SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, (x1 + x2) / 2 / 1280 AS xc, (y1 + y2) / 2 / 960 AS yc,
    (x2 - x1) / 1280 AS bw, (y2 - y1) / 960 AS bh FROM v_labels""")
def label_format(spark, d):
    """M11, I36."""
    out = boxes.formatted(view(spark, d, "v_labels"), 1280, 960)
    return out.select("image_id", *KEY, "xc", "yc", "bw", "bh")


@query()
def class_texts(spark, d):
    """Own classes first, then others in a seeded order."""
    out = boxes.class_texts(view(spark, d, "v_labels"), "image_id", ["a", "n", "r", "x", "y"], 4, 3)
    return out.select("image_id", F.array_join("texts", ",").alias("texts"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query()
def suppressed_predictions(spark, d):
    """Greedy suppression by intersection over the smaller box; tested against a plain loop."""
    return matching.suppress(predictions(spark, d), "pred_id")


@query("""WITH g AS (SELECT * FROM (SELECT unnest([1, 2, 3]) AS seed) a, (SELECT DISTINCT train_size FROM v_results) b, (SELECT DISTINCT run FROM v_results) e, (SELECT DISTINCT conf FROM v_results) f)
    SELECT g.seed, g.train_size, g.run, g.conf, count(r.epoch) AS n FROM g LEFT JOIN v_results r ON r.train_size = g.train_size AND r.run = g.run AND r.conf = g.conf AND r.epoch % 3 + 1 = g.seed
    GROUP BY g.seed, g.train_size, g.run, g.conf""")
def experiment_grid(spark, d):
    """All settings of an experiment, with the results that exist for each."""
    rows = view(spark, d, "v_results").withColumn("seed", (F.col("epoch") % 3 + 1).cast("int"))
    return experiments.grid(rows, {"seed": [1, 2, 3]}, ["train_size", "run", "conf"])


@query("""SELECT week, month, count(*) AS n FROM (SELECT CAST(week(o_orderdate) AS INT) AS week, CAST(month(o_orderdate) AS INT) AS month FROM orders) GROUP BY week, month""")
def weeks_and_months(spark, d):
    """Distinct attributes with their sizes."""
    rows = table(spark, d, "orders").select(F.weekofyear("o_orderdate").alias("week"), F.month("o_orderdate").alias("month"))
    return rows.groupBy("week", "month").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_filter_stats(spark, sf_dir)


__all__ = ["ORACLE", "QUERIES", "S", "flagship"]
