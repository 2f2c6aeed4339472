"""Registered queries over masks and polygons, the prediction chain and runs that are resumed."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.functions import rle
from quadrat.operators import masks, mosaics, splitting, tiling
from quadrat.plans import pipeline, predicting
from quadrat.plans.catalogue import _CATS, _TILES, AREA, annotations, categories, query
from quadrat.plans.views import table, view
from quadrat.session import scratch, stored
from quadrat.sources import files as read
from quadrat.sources import sinks
from quadrat.streaming import ingest

#: Sides of a pixel, as in the operator: what stands beyond, and the corners where the side begins and ends.
_SIDES = "(VALUES (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0)) AS s(side, dx, dy, u1, u2, v1, v2)"


@query(f"""
    WITH RECURSIVE p AS (SELECT vec_id, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y
      FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) WHERE embedding[i + 1] > 0),
    c AS (SELECT p.vec_id, p.x, p.y, side, p.x + u1 AS u1, p.y + u2 AS u2, p.x + v1 AS v1, p.y + v2 AS v2
      FROM p CROSS JOIN {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.vec_id = p.vec_id AND q.x = p.x + dx AND q.y = p.y + dy)),
    nxt AS (SELECT a.vec_id, a.x, a.y, a.side, b.x AS nx, b.y AS ny, b.side AS nside FROM c a JOIN c b ON b.vec_id = a.vec_id AND b.u1 = a.v1 AND b.u2 = a.v2
      QUALIFY row_number() OVER (PARTITION BY a.vec_id, a.x, a.y, a.side ORDER BY CASE WHEN a.x = b.x AND a.y = b.y THEN 1 ELSE 0 END) = 1),
    heads AS (SELECT vec_id, x, y FROM c WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.vec_id = c.vec_id AND q.y = c.y - 1 AND abs(q.x - c.x) <= 1)),
    walk AS (SELECT vec_id, x AS hx, y AS hy, x, y, 0 AS side, 0 AS step FROM heads
      UNION ALL
      SELECT w.vec_id, hx, hy, nx, ny, nside, step + 1 FROM walk w JOIN nxt n ON n.vec_id = w.vec_id AND n.x = w.x AND n.y = w.y AND n.side = w.side
      WHERE NOT (nx = hx AND ny = hy AND nside = 0)),
    air AS (SELECT DISTINCT vec_id, -1 :: BIGINT AS x, -1 :: BIGINT AS y FROM p
      UNION
      SELECT a.vec_id, a.x + dx, a.y + dy FROM air a CROSS JOIN {_SIDES}
      WHERE a.x + dx BETWEEN -1 AND 8 AND a.y + dy BETWEEN -1 AND 8 AND NOT EXISTS (SELECT 1 FROM p WHERE p.vec_id = a.vec_id AND p.x = a.x + dx AND p.y = a.y + dy)),
    good AS (SELECT vec_id, hx, hy FROM walk GROUP BY ALL HAVING bool_and(y > hy OR y = hy AND x >= hx)),
    ring AS (SELECT w.* FROM walk w JOIN good g ON g.vec_id = w.vec_id AND g.hx = w.hx AND g.hy = w.hy JOIN air a ON a.vec_id = w.vec_id AND a.x = w.hx - 1 AND a.y = w.hy),
    pixel AS (SELECT vec_id, hx, hy, step, x, y FROM ring WINDOW r AS (PARTITION BY vec_id, hx, hy ORDER BY step) QUALIFY step = 0 OR x <> lag(x) OVER r OR y <> lag(y) OVER r),
    shut AS (SELECT *, max(step) OVER r AS final, count(*) OVER r AS n FROM pixel WINDOW r AS (PARTITION BY vec_id, hx, hy)),
    chain AS (SELECT * FROM shut WHERE NOT (n > 1 AND step = final AND x = hx AND y = hy)),
    around AS (SELECT *, coalesce(lag(x) OVER r, last_value(x) OVER w) AS px, coalesce(lag(y) OVER r, last_value(y) OVER w) AS py,
        coalesce(lead(x) OVER r, first_value(x) OVER w) AS ax, coalesce(lead(y) OVER r, first_value(y) OVER w) AS ay
      FROM chain WINDOW r AS (PARTITION BY vec_id, hx, hy ORDER BY step), w AS (PARTITION BY vec_id, hx, hy ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT vec_id, hy AS y, hx AS x, string_agg(x || ' ' || y, ' ' ORDER BY step) AS points FROM around
    WHERE x - px <> ax - x OR y - py <> ay - y GROUP BY vec_id, hy, hx HAVING count(*) >= 3""")
def mask_contours(spark, d):
    """Outer contours of masks, from run lengths."""
    bits = F.transform("embedding", lambda e: F.when(e > 0, 1).otherwise(0))
    rows = table(spark, d, "embeddings").select("vec_id", rle.encode(bits).alias("runs"), F.lit(8).alias("width"))
    found = masks.contours(rows, "vec_id", "runs", "width")
    return found.select("vec_id", "y", "x", F.array_join(F.col("points").cast("array<string>"), " ").alias("points"))


_RING = [f"CAST(round(embedding[{i}] * 60) AS BIGINT)" for i in range(1, 11)]
_RUNS = f"""
    e AS (SELECT vec_id, [{', '.join(_RING[::2])}] AS xs, [{', '.join(_RING[1::2])}] AS ys FROM embeddings),
    b AS (SELECT vec_id, xs, ys, list_min(xs) AS l, list_min(ys) AS t, list_max(xs) - list_min(xs) + 1 AS w, list_max(ys) - list_min(ys) + 1 AS h FROM e),
    q AS (SELECT *, unnest(range(w * h)) AS i FROM b),
    g AS (SELECT *, l + i % w AS x, t + i // w AS y FROM q),
    s AS (SELECT vec_id, i, x, y, xs[k] AS ax, ys[k] AS ay, xs[k % 5 + 1] AS cx, ys[k % 5 + 1] AS cy FROM g, (SELECT unnest(range(1, 6)) AS k)),
    m AS (SELECT vec_id, i, CASE WHEN bool_or((cx - ax) * (y - ay) = (cy - ay) * (x - ax) AND x BETWEEN least(ax, cx) AND greatest(ax, cx) AND y BETWEEN least(ay, cy) AND greatest(ay, cy))
        OR sum(CASE WHEN (ay > y) <> (cy > y) AND (x - ax) * abs(cy - ay) < (cx - ax) * (y - ay) * sign(cy - ay) THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE 0 END AS bit FROM s GROUP BY vec_id, i),
    f AS (SELECT vec_id, i, bit, coalesce(lag(bit) OVER (PARTITION BY vec_id ORDER BY i), 0) AS before FROM m),
    u AS (SELECT vec_id, i, bit, sum(CASE WHEN bit <> before THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM f),
    r AS (SELECT vec_id, run, count(*) AS n FROM u GROUP BY ALL),
    z AS (SELECT vec_id, CASE WHEN min(run) = 0 THEN '' ELSE '0,' END || string_agg(n, ',' ORDER BY run) AS rle FROM r GROUP BY vec_id)"""


def _ring():
    return F.transform(F.slice("embedding", 1, 10), lambda c: F.round(c * 60).cast("double"))


@query(f"WITH {_RUNS} SELECT b.vec_id, l AS \"left\", t AS top, w AS width, h AS height, rle FROM b JOIN z ON z.vec_id = b.vec_id")
def polygon_run_lengths(spark, d):
    """Polygons to run lengths in the smallest box around them."""
    rows = table(spark, d, "embeddings").select("vec_id", _ring().alias("coords"))
    found = masks.polygon_runs(rows, "vec_id", "coords")
    return found.select("vec_id", "left", "top", "width", "height", F.array_join(F.col("runs").cast("array<string>"), ",").alias("rle"))


@query("""
    WITH t AS (SELECT vec_id, embedding AS e FROM embeddings),
    v AS (SELECT vec_id, which, k, CAST(e[6 * which + 2 * k + 1] AS DOUBLE) * 100 AS x, CAST(e[6 * which + 2 * k + 2] AS DOUBLE) * 100 AS y,
        CAST(e[6 * which + 2 * ((k + 1) % 3) + 1] AS DOUBLE) * 100 AS nx, CAST(e[6 * which + 2 * ((k + 1) % 3) + 2] AS DOUBLE) * 100 AS ny
      FROM t, (SELECT unnest([0, 1]) AS which), (SELECT unnest([0, 1, 2]) AS k)),
    b AS (SELECT vec_id, min(x) AS low FROM v GROUP BY vec_id),
    s AS (SELECT v.vec_id, which, least(y, ny) AS y0, greatest(y, ny) AS y1, CASE WHEN y <= ny THEN x ELSE nx END - low AS x0, (nx - x) / (ny - y) AS slope, CASE WHEN y <= ny THEN 1 ELSE -1 END AS sign
      FROM v JOIN b ON b.vec_id = v.vec_id WHERE y <> ny),
    p AS (SELECT e.vec_id, e.sign * f.sign AS sign, greatest(e.y0, f.y0) AS a, least(e.y1, f.y1) AS z, e.x0 AS ex, e.y0 AS ey, e.slope AS es, f.x0 AS fx, f.y0 AS fy, f.slope AS fs
      FROM s e JOIN s f ON f.vec_id = e.vec_id AND e.which = 0 AND f.which = 1 AND greatest(e.y0, f.y0) < least(e.y1, f.y1)),
    h AS (SELECT vec_id, sign, z - a AS w, ex + es * (a - ey) AS p0, fx + fs * (a - fy) AS q0, ex + es * (z - ey) AS p1, fx + fs * (z - fy) AS q1 FROM p),
    i AS (SELECT vec_id, abs(sum(sign * w * CASE WHEN (p0 - q0) * (p1 - q1) < 0
        THEN ((p0 - q0) / (p0 - q0 - p1 + q1) * (least(p0, q0) - least(p1, q1)) + p0 + (p0 - q0) / (p0 - q0 - p1 + q1) * (p1 - p0) + least(p1, q1)) / 2
        ELSE (least(p0, q0) + least(p1, q1)) / 2 END)) AS i FROM h GROUP BY vec_id),
    u AS (SELECT vec_id, sum(a) AS u FROM (SELECT vec_id, which, abs(sum(x * ny - nx * y)) / 2 AS a FROM v GROUP BY vec_id, which) GROUP BY vec_id)
    SELECT u.vec_id, round(coalesce(i, 0), 4) AS shared, round(CASE WHEN coalesce(i, 0) > 0 THEN i / (u - i) ELSE 0 END, 6) AS iou FROM u LEFT JOIN i ON i.vec_id = u.vec_id""")
def polygon_overlaps(spark, d):
    """Exact overlap of polygons that are no rectangles."""
    part = lambda first: F.transform(F.slice("embedding", first, 6), lambda c: c.cast("double") * 100)
    rows = table(spark, d, "embeddings").select("vec_id", part(1).alias("a"), part(7).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("vec_id", F.round(G.overlap_area(a, b), 4).alias("shared"), F.round(G.polygon_iou(a, b), 6).alias("iou"))


#: What a box shares with a tile. The label is a box with a notch from above: left leg, floor and right leg.
_CUT = "greatest(least({x2}, tx + 640) - greatest({x1}, tx), 0) * greatest(least({y2}, ty + 640) - greatest({y1}, ty), 0)"


@query(f"""
    WITH tiles AS ({_TILES}), u AS (SELECT l.image_id, class_id, l.x1, l.y1, l.x2, l.y2, t.x0 AS tx, t.y0 AS ty
      FROM v_labels l JOIN tiles t ON t.image_id = l.image_id AND l.x1 < t.x0 + 640 AND l.x2 > t.x0 AND l.y1 < t.y0 + 640 AND l.y2 > t.y0),
    a AS (SELECT *, {_CUT.format(x1='x1', y1='y1', x2='x1 + 3', y2='y2')} AS l, {_CUT.format(x1='x1 + 3', y1='y1 + 5', x2='x2 - 3', y2='y2')} AS f,
        {_CUT.format(x1='x2 - 3', y1='y1', x2='x2', y2='y2')} AS r, (x2 - x1) * (y2 - y1) - (x2 - x1 - 6) * 5 AS whole FROM u),
    k AS (SELECT *, l + f + r AS inside, CASE WHEN f > 0 THEN 1 ELSE (CASE WHEN l > 0 THEN 1 ELSE 0 END) + (CASE WHEN r > 0 THEN 1 ELSE 0 END) END AS parts FROM a)
    SELECT image_id, tx, ty, class_id, CAST(sum(parts) AS BIGINT) AS n, round(sum(inside), 3) AS inside FROM k
    WHERE inside > 0.5 * whole OR (inside >= 20 AND inside >= 0.1 * whole) GROUP BY image_id, tx, ty, class_id""")
def tile_concave_labels(spark, d):
    """Concave polygons cut to tiles, each part by itself."""
    images = view(spark, d, "v_images")
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    ring = F.array(x1, y1, x1 + 3, y1, x1 + 3, y1 + 5, x2 - 3, y1 + 5, x2 - 3, y1, x2, y1, x2, y2, x1, y2)
    rows = view(spark, d, "v_labels").join(images.select("image_id", "width", "height"), "image_id")
    shares = F.transform(ring, lambda c, i: c / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    parts = tiling.tile_polygons(rows.select("image_id", "class_id", shares.alias("coords")), images, wanted=())
    return parts.groupBy("image_id", "tx", "ty", "class_id").agg(F.count("*").alias("n"), F.round(F.sum("inside"), 3).alias("inside"))


@query(f"""WITH {_CATS}, d AS (SELECT id, CASE id % 3 WHEN 2 THEN 2 ELSE 1 END AS category_id FROM v_coco_images_add),
    cm AS (SELECT b.id AS own, a.id AS ext FROM v_coco_images_base b JOIN v_coco_images_add a ON regexp_extract(b.file_name, '[^/]*$') = regexp_extract(a.file_name, '[^/]*$')),
    th AS (SELECT cm.own AS image_id, cats.id AS category_id FROM d JOIN cm ON d.id = cm.ext JOIN cats ON cats.extra_id = d.category_id WHERE d.id % 7 <> 0),
    ow AS (SELECT x.image_id, cats.id AS category_id FROM v_coco_anns_base x JOIN v_coco_images_base b ON x.image_id = b.id JOIN cats ON cats.base_id = x.category_id
      WHERE x.image_id NOT IN (SELECT image_id FROM th)),
    al AS (SELECT 'extra' AS side, category_id FROM th UNION ALL SELECT 'base', category_id FROM ow)
    SELECT concat(side, ' ', category_id) AS part, count(*) AS n FROM al GROUP BY side, category_id
    UNION ALL SELECT 'predict', (SELECT count(*) FROM d) + (SELECT count(*) FROM d WHERE id % 4 = 0)
    UNION ALL SELECT 'fix', (SELECT count(*) FROM d WHERE id % 7 <> 0) UNION ALL SELECT 'combine', (SELECT count(*) FROM al)""")
def prediction_chain(spark, d):
    """O3, with F29 and F30: predict, repair, merge; what passed each step is counted on the way."""

    def load():
        def model(images: pd.DataFrame) -> pd.DataFrame:
            one = pd.DataFrame({"image_id": images["id"], "class_name": (images["id"] % 3).map({0: "A", 1: "R", 2: "X"}), "conf": 0.5})
            one = one.assign(x1=images["id"] % 50 * 1.0, y1=images["id"] % 70 * 1.0, polygon=None)
            one = one.assign(x2=one["x1"] + 10, y2=one["y1"] + 20)
            one["polygon"] = [[[]] if i % 7 == 0 else None for i in one["image_id"]]  # a polygon without points
            flat = one[one["image_id"] % 4 == 0].assign(x2=lambda r: r["x1"])  # a box without extent
            names = [c.split()[0] for c in predicting.SCHEMA.split(", ")]
            return pd.concat([one, flat])[names]

        return model

    chain = predicting.Chain(
        images=view(spark, d, "v_coco_images_add"), load=load, class_ids={"R": 1, "X": 2}, categories=categories(spark, d),
        base=(view(spark, d, "v_coco_images_base"), annotations(spark, d, "base")),
    )
    merged, counters = predicting.run(chain)
    parts = stored(merged.select(F.concat_ws(" ", "side", "category_id").alias("part")))
    steps = spark.createDataFrame([(step, seen.get["n"]) for step, seen in counters.items()], "part string, n long")
    return parts.groupBy("part").agg(F.count("*").alias("n")).unionByName(steps)


@query("""SELECT image_id, dataset, ((width + 319) // 320) * ((height + 319) // 320) AS n, count(*) OVER (PARTITION BY dataset) AS processed FROM v_images""")
def resumed_tiles(spark, d):
    """Tiles of images in batches; the run breaks off in its second batch and is resumed. With the counters."""
    source, out, state = scratch(spark), scratch(spark), scratch(spark)
    view(spark, d, "v_images").repartition(4, "image_id").write.parquet(source)
    schema, tries = spark.read.parquet(source).schema, []

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def tiles(batch):
        tries.append(1)
        if len(tries) == 2:
            raise RuntimeError("stopped half way")
        return batch.select("image_id", "dataset").join(tiling.tile_estimate(batch).select("image_id", "n"), "image_id")

    try:
        ingest.run_resumable(stream(), tiles, "dataset", out, state).awaitTermination()
    except StreamingQueryException:
        ingest.run_resumable(stream(), tiles, "dataset", out, state).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").select("image_id", "dataset", "n")
    return rows.join(ingest.progress(spark, out, "dataset"), "dataset")


@query(f"""WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id) AS rn, count(*) OVER () - 3 AS m FROM v_images),
    s AS (SELECT image_id, CASE WHEN rn = 1 THEN 'train' WHEN rn = 2 THEN 'val' WHEN rn = 3 THEN 'test' WHEN rn - 3 <= floor(m * 0.7) THEN 'train'
      WHEN rn - 3 <= floor(m * 0.7) + floor(m * 0.15) THEN 'val' ELSE 'test' END AS split FROM r),
    f AS (SELECT image_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM v_labels WHERE {AREA} >= CASE class_id WHEN 0 THEN 400 WHEN 1 THEN 500 ELSE 600 END),
    t AS ({_TILES}),
    c AS (SELECT t.image_id, t.x0, t.y0, f.area, (least(f.x2, t.x1) - greatest(f.x1, t.x0)) * (least(f.y2, t.y1) - greatest(f.y1, t.y0)) AS inside
      FROM t JOIN f ON f.image_id = t.image_id AND f.x1 < t.x1 AND f.x2 > t.x0 AND f.y1 < t.y1 AND f.y2 > t.y0),
    k AS (SELECT image_id, x0, y0, count(*) AS n FROM c WHERE inside > 0.5 * area OR (inside >= 20 AND inside >= 0.1 * area) GROUP BY ALL),
    e AS (SELECT concat(t.image_id, '_', t.x0, '_', t.y0) AS image_id, s.split, coalesce(k.n, 0) AS n FROM t JOIN s ON s.image_id = t.image_id
      LEFT JOIN k ON k.image_id = t.image_id AND k.x0 = t.x0 AND k.y0 = t.y0),
    b AS (SELECT *, row_number() OVER (PARTITION BY split, n > 0 ORDER BY md5(concat('42:', image_id)), image_id) AS rn,
        count(*) FILTER (n > 0) OVER (PARTITION BY split) AS ne, count(*) FILTER (n = 0) OVER (PARTITION BY split) AS em FROM e)
    SELECT image_id, split, n FROM b WHERE ne > 0 AND rn <= CASE WHEN em = 0 THEN ne ELSE least(ne, em) END""")
def prepared_tiles(spark, d):
    """O1: all four steps, filter, split, patch and balance, row by row."""
    images, v = view(spark, d, "v_images").select("image_id", "width", "height"), view(spark, d, "v_labels")
    sized = v.join(images, "image_id")
    ring = G.box_polygon(*map(F.col, ("x1", "y1", "x2", "y2")))
    shares = F.transform(ring, lambda c, i: c / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    settings = pipeline.Settings.of({"filter": {"min_pixel_area": [399.999, 499.999, 599.999]}, "split": {"split_field": None, "seed": 42}})
    done, kept = pipeline.prepare(images, sized.select("image_id", "class_id", shares.alias("coords")), settings)
    counted = kept.groupBy("image_id").agg(F.count("*").alias("n"))
    return done.join(counted, "image_id", "left").select("image_id", "split", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_RUNS} SELECT b.vec_id AS image_id, concat('set/', b.vec_id, '.jpg') AS name, CASE WHEN b.vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS label, l AS \"left\", t AS top, w AS width, h AS height, rle FROM b JOIN z ON z.vec_id = b.vec_id")
def cvat_mask_document(spark, d):
    """Polygons as masks of a CVAT document, written and read."""
    rows = table(spark, d, "embeddings").select("vec_id", _ring().alias("coords"))
    name = F.concat(F.lit("set/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("name")
    found = masks.polygon_runs(rows, "vec_id", "coords").select("*", name, F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("label"))
    path = scratch(spark)
    sinks.write_cvat_masks(found.withColumnRenamed("vec_id", "image_id"), path)
    back = read.cvat_masks(spark, path)
    return back.select("image_id", "name", "label", "left", "top", "width", "height", F.array_join(F.col("runs").cast("array<string>"), ",").alias("rle"))


@query("""WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id) AS rn, count(*) OVER () AS m FROM v_images),
    s AS (SELECT CASE WHEN rn <= floor(m * 0.7) THEN 'train' WHEN rn <= floor(m * 0.7) + floor(m * 0.15) THEN 'val' ELSE 'test' END AS split, m FROM r)
    SELECT split, count(*) AS n, round(abs(count(*) / min(m) - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END), 9) AS deviation FROM s GROUP BY split""")
def preview_split(spark, d):
    """The random split that is only looked at: sizes and distances from the targets."""
    return splitting.preview_summary(splitting.preview(view(spark, d, "v_images").select("image_id"), "image_id"))


@query("""WITH i AS (SELECT image_id // 3 AS mosaic, CAST(image_id % 3 AS INT) AS place, width // 4 AS w, height // 4 AS h FROM v_images),
    f AS (SELECT mosaic, w AS w0, h AS h0 FROM i WHERE place = 0),
    c AS (SELECT i.mosaic, place, w, h, w0, h0, CASE place WHEN 0 THEN 640 WHEN 1 THEN 640 + w0 ELSE 640 - w END AS dx, CASE place WHEN 2 THEN 640 + h0 - h ELSE 640 END AS dy,
      CASE place WHEN 0 THEN 640 + w WHEN 1 THEN 640 + w0 + w ELSE 640 END AS r, CASE place WHEN 2 THEN 640 + h0 ELSE 640 + h END AS b FROM i JOIN f ON f.mosaic = i.mosaic)
    SELECT mosaic, place, dx, dy, greatest(dx, 0) AS ax1, greatest(dy, 0) AS ay1, greatest(r, 0) AS ax2, greatest(b, 0) AS ay2 FROM c""")
def mosaic_row(spark, d):
    """Three images in a row."""
    v = view(spark, d, "v_images").select(F.expr("image_id div 3").alias("mosaic"), (F.col("image_id") % 3).cast("int").alias("place"), F.expr("width div 4").alias("width"), F.expr("height div 4").alias("height"))
    whole = v.join(v.where("place = 0").select("mosaic"), "mosaic", "left_semi")
    return mosaics.mosaic3(whole, 640).select("mosaic", "place", "dx", "dy", "ax1", "ay1", "ax2", "ay2")
