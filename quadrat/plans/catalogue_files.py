"""More registered queries: tables of paths, and round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.functions import names as N
from quadrat.operators import counting, filters, folders
from quadrat.plans.catalogue import AREA, files, query
from quadrat.plans.views import VIEWS, table, view
from quadrat.session import scratch
from quadrat.sources import files as read
from quadrat.sources import manifest, sinks

VIEWS |= {
    "v_label_paths": """
        SELECT doc_id, source, concat('data/labels/', coalesce(lang, 'xx'), '/', CAST(doc_id AS STRING), '.txt') AS label_path FROM documents""",
    "v_image_paths": """
        SELECT doc_id, source, n_chars, concat('data/images/', coalesce(lang, 'xx'), '/', CAST(doc_id AS STRING),
               CASE n_chars % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.bmp' ELSE '.tif' END) AS image_path FROM documents
        UNION ALL
        SELECT doc_id, source, n_chars, concat('data/images/', coalesce(lang, 'xx'), '/', CAST(doc_id AS STRING), '.jpeg') AS image_path
        FROM documents WHERE n_chars % 5 = 0""",
    "v_quads": """
        SELECT l_suppkey AS stem, class_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM v_labels""",
}


# ---- tables of paths -------------------------------------------------------------------------------------------------

_KEYED = "regexp_replace(image_path, '\\.[^.]*$', '')"


@query(f"""WITH i AS (SELECT image_path, {_KEYED} AS k, list_position(['jpg', 'jpeg', 'png', 'bmp'], regexp_extract(image_path, '[^.]*$')) AS r FROM v_image_paths),
    b AS (SELECT k, arg_min(image_path, r) AS image_path FROM i WHERE r > 0 GROUP BY k)
    SELECT label_path, image_path FROM v_label_paths l LEFT JOIN b ON b.k = replace(regexp_replace(label_path, '\\.txt$', ''), 'labels', 'images')""")
def images_of_labels(spark, d):
    """The image of a label file, by trying extensions."""
    return folders.images_of_labels(view(spark, d, "v_label_paths"), view(spark, d, "v_image_paths"))


@query(f"SELECT image_path, label_path FROM v_image_paths i JOIN v_label_paths l ON {_KEYED} = replace(regexp_replace(label_path, '\\.txt$', ''), 'labels', 'images')")
def paths_by_stem(spark, d):
    """D3, A8."""
    return folders.pairs(view(spark, d, "v_image_paths"), view(spark, d, "v_label_paths"))


@query("""SELECT a.image_path, b.label_path FROM (SELECT image_path, row_number() OVER (ORDER BY image_path) AS rn FROM v_image_paths) a
    JOIN (SELECT label_path, row_number() OVER (ORDER BY label_path) AS rn FROM v_label_paths) b ON a.rn = b.rn""")
def paths_by_position(spark, d):
    """The i-th image with the i-th label."""
    return folders.pairs(view(spark, d, "v_image_paths"), view(spark, d, "v_label_paths"), True)


@query(f"SELECT image_path FROM v_image_paths WHERE {_KEYED} IN (SELECT replace(regexp_replace(label_path, '\\.txt$', ''), 'labels', 'images') FROM v_label_paths WHERE source = 'web')")
def images_with_labels(spark, d):
    """C22."""
    return folders.with_known_stem(view(spark, d, "v_image_paths"), view(spark, d, "v_label_paths").where("source = 'web'")).select("image_path")


@query("""SELECT file_name FROM (SELECT regexp_extract(image_path, '[^/]*$') AS name, max(image_path) AS file_name FROM v_image_paths GROUP BY 1)
    WHERE name IN (SELECT regexp_extract(image_path, '[^/]*$') FROM v_image_paths WHERE n_chars % 5 = 0)""")
def names_in_both(spark, d):
    """Names of the whole set that are in another one too."""
    v = view(spark, d, "v_image_paths").withColumnRenamed("image_path", "file_name")
    both = folders.common_names(v, v.where("n_chars % 5 = 0"))
    named = v.groupBy(N.basename(F.col("file_name")).alias("name")).agg(F.max("file_name").alias("file_name"))
    return named.join(both, "name", "left_semi").select("file_name")


@query("SELECT doc_id, '' AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def blank_labels(spark, d):
    """J10."""
    return folders.blank_labels(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT dataset, count(*) AS n FROM v_images WHERE dataset NOT IN ('1-URGENT', '5-LOW') GROUP BY dataset")
def folders_kept(spark, d):
    """B20."""
    return folders.without_folders(view(spark, d, "v_images"), excluded=("1-URGENT", "5-LOW")).groupBy("dataset").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, regexp_replace(filename, '^(\\w+)_R1_([0-9]{8})_w[0-9]_(T[0-9]{2}_[0-9]{2}\\.jpg)', '\\1_R9_\\2_w3_\\3') AS corrected FROM v_files""")
def corrected_names(spark, d):
    """I9, B21."""
    return view(spark, d, "v_files").select("o_orderkey", folders.corrected_name(F.col("filename"), "R1", "R9", 3).alias("corrected"))


@query("SELECT 1 + max(o_orderkey) FILTER (o_orderpriority = '2-HIGH') AS number FROM orders")
def next_run(spark, d):
    """G15."""
    name = F.concat(F.when(F.col("o_orderpriority") == "2-HIGH", "val_").otherwise("test_"), F.col("o_orderkey").cast("string"))
    return folders.next_number(table(spark, d, "orders").select(name.alias("name")), "name", "val")


@query("SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang")
def first_of_each(spark, d):
    """G11."""
    return folders.first_of_each(table(spark, d, "documents").select("lang", "doc_id", "source"), "lang", ["doc_id"])


@query("""WITH u AS (SELECT 'train' AS split, image_path AS path FROM v_image_paths UNION ALL
      SELECT 'val', replace(image_path, 'images', 'more') FROM v_image_paths WHERE source = 'web')
    SELECT regexp_extract(path, '[^/]*$') AS name, arg_max(split, path) AS split, max(path) AS path FROM u GROUP BY 1""")
def unsplit(spark, d):
    """Splits merged to one set; the last of equal names stays."""
    v = view(spark, d, "v_image_paths").select(F.col("image_path").alias("path"), "source")
    other = v.where("source = 'web'").withColumn("path", F.regexp_replace("path", "images", "more"))
    return folders.unsplit({"train": v, "val": other})


@query(f"""WITH p AS (SELECT string_split(image_path, '/') AS p FROM v_image_paths UNION ALL SELECT ['data', '.git', 'x.cfg']
      UNION ALL SELECT ['data', 'train.txt'] UNION ALL SELECT ['data', 'a.yaml']),
    c AS (SELECT array_to_string(p[1:n], '/') AS entry, CAST(n - 1 AS INT) AS depth, n < len(p) AS is_dir, p[n] AS name,
          len(list_filter(p[1:n], lambda x: starts_with(x, '.'))) > 0 AS hidden FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS n) u)
    SELECT DISTINCT entry, depth, is_dir, concat(repeat('    ', depth), name, CASE WHEN is_dir THEN '/' ELSE '' END) AS text FROM c
    WHERE depth <= 3 AND NOT hidden AND (is_dir OR name = 'train.txt' OR NOT lower(regexp_extract(name, '[^.]*$')) IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'txt'))""")
def folder_tree(spark, d):
    """C25, C26, I15."""
    few = spark.createDataFrame([("data/.git/x.cfg",), ("data/train.txt",), ("data/a.yaml",)], "path string")
    return folders.tree(view(spark, d, "v_image_paths").select(F.col("image_path").alias("path")).unionByName(few))


@query("SELECT split_part(image_path, '/', 3) AS lang, count(*) AS n, count(DISTINCT split_part(image_path, '/', 4)) AS n_names FROM v_image_paths GROUP BY 1")
def folder_walk(spark, d):
    """A25, E7."""
    w = folders.walk(view(spark, d, "v_image_paths"), ["root", "kind", "lang", "name"], "image_path")
    return w.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query("""SELECT row_number() OVER (ORDER BY image_path) - 1 AS id, regexp_extract(image_path, '[^/]*$') AS file_name, 0 AS width, 0 AS height FROM v_image_paths""")
def image_table(spark, d):
    """An image table of files in order of name."""
    return folders.image_table(view(spark, d, "v_image_paths"), "image_path")


@query("""SELECT source AS dataset, count(*) FILTER (lang IS NOT NULL) AS image, count(*) FILTER (n_chars > 900) AS label,
    count(*) FILTER (lang IS NULL) AS missing_images, count(*) FILTER (NOT n_chars > 900) AS missing_labels FROM documents GROUP BY source""")
def copy_counters(spark, d):
    """F29."""
    rows = table(spark, d, "documents").select(F.col("source").alias("dataset"), F.col("lang").isNotNull().alias("has_image"), (F.col("n_chars") > 900).alias("has_label"))
    return folders.copy_counters(rows)


@query("""SELECT count(*) AS n_images, count(*) FILTER (n > 0) AS processed, count(*) FILTER (n = 0) AS skipped, CAST(sum(n) AS BIGINT) AS n_labels
    FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)""")
def evaluation_summary(spark, d):
    """F30."""
    from quadrat.operators.metrics import run_summary

    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("n"))
    return run_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")), counted)


@query("""SELECT o_orderkey, week FROM (SELECT o_orderkey, TRY_CAST(regexp_extract(filename, '_w([0-9]+)_', 1) AS INT) AS week, filename FROM v_files)
    WHERE regexp_matches(filename, '^SITE_S4_.+_[0-9]{8}_w[0-9]+_T0._1.\\.jpg')""")
def specimen_weeks(spark, d):
    """One specimen's files over the weeks."""
    return folders.named_like(view(spark, d, "v_files"), "filename", "SITE", "S4", "T0.", "1.").select("o_orderkey", "week")


_FACTS = """f AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr,
    count(*) FILTER (lang = 'es') AS es, count(*) FILTER (n_chars > 2000) AS long_ FROM documents GROUP BY source),
    b AS (SELECT source, count(*) FILTER (n_chars < 100 AND rn <= 5) AS bad FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY source)"""
_MESSAGE = """CASE WHEN NOT en > 0 THEN 'manifest not found' WHEN NOT de % 5 > 0 THEN 'manifest has no names' WHEN NOT fr % 4 > 0 THEN 'manifest has no path'
    WHEN NOT es % 3 > 0 THEN 'list of images not found' WHEN n % 2 = 0 THEN 'list of images is empty' WHEN bad > 0 THEN 'listed paths aren''t in an images folder'
    WHEN long_ = 0 THEN 'no image exists' WHEN n % 7 = 0 THEN 'no label file exists' ELSE '' END"""


def _findings(spark, d) -> DataFrame:
    """What validation finds in exported folders, drawn from counts of documents so that every rule can fail."""
    docs = table(spark, d, "documents")
    some = lambda lang: F.count_if(F.coalesce(F.col("lang") == lang, F.lit(False)))
    facts = docs.groupBy(F.col("source").alias("dataset")).agg(
        F.count("*").alias("n"), (some("en") > 0).alias("has_manifest"), (some("de") % 5 > 0).alias("has_names"), (some("fr") % 4 > 0).alias("has_path"),
        (some("es") % 3 > 0).alias("has_list"), F.count_if(F.col("n_chars") > 2000).alias("n_images"),
    )
    first = filters.first_paths(docs.select(F.col("source").alias("dataset"), "doc_id", "n_chars"), "dataset", "doc_id", 5)
    bad = first.groupBy("dataset").agg(F.count_if(F.col("n_chars") < 100).alias("n_bad_paths"))
    return facts.join(bad, "dataset").withColumns({"n_listed": F.col("n") % 2, "n_labels": F.col("n") % 7})


@query(f"WITH {_FACTS} SELECT f.source AS dataset, {_MESSAGE} AS message, {_MESSAGE} = '' AS ok FROM f JOIN b ON f.source = b.source")
def export_validation(spark, d):
    """Every rule, the first failure told."""
    return filters.invalid_manifest(_findings(spark, d))


@query(f"""WITH {_FACTS}, m AS (SELECT f.source AS dataset, {_MESSAGE} AS message FROM f JOIN b ON f.source = b.source)
    SELECT count(*) FILTER (message = '') AS n_valid, count(*) FILTER (message <> '') AS n_invalid,
           coalesce(string_agg(concat(dataset, ': ', message), '; ' ORDER BY dataset) FILTER (message <> ''), '') AS errors FROM m""")
def export_summary(spark, d):
    """C19."""
    s = folders.validation_summary(filters.invalid_manifest(_findings(spark, d)))
    told = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return s.select("n_valid", "n_invalid", F.array_join(told, "; ").alias("errors"))


@query("""SELECT concat('out/', image_path) AS dst, concat('in/', image_path) AS src FROM v_image_paths UNION ALL
    SELECT concat('out/', l), concat('in/', l) FROM (SELECT concat(regexp_replace(replace(image_path, 'images', 'labels'), '\\.[^.]*$', ''), '.txt') AS l FROM v_image_paths)""")
def copy_plan(spark, d):
    """Where images and labels go, relative paths kept."""
    v = view(spark, d, "v_image_paths").select(F.concat(F.lit("in/"), "image_path").alias("image_path"))
    return sinks.copy_plan(v, "in/", "out/").select("src", "dst")


@query("""SELECT split, array_to_string(list_sort(list(DISTINCT concat(folder, '/images'))), ',') AS folders
    FROM (SELECT concat(CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val' ELSE 'test' END, '_', CAST(o_shippriority + o_custkey % 4 AS VARCHAR)) AS folder,
      CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val' ELSE 'test' END AS split FROM (SELECT *, 0 AS o_shippriority FROM orders)) GROUP BY split""")
def tiled_manifest(spark, d):
    """B2."""
    status = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    path = F.concat(F.lit("out/"), status, F.lit("_"), (F.col("o_custkey") % 4).cast("string"), F.lit("/images/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    return sinks.tiled_manifest(table(spark, d, "orders").select(path.alias("path"))).select("split", F.array_join("folders", ",").alias("folders"))


@query("""SELECT concat('train_', CAST(n AS VARCHAR), '/images') AS folder, count(*) AS n FROM orders, (SELECT unnest(range(10, 101, 10)) AS n) WHERE o_orderkey % 100 < n GROUP BY 1""")
def cumulative_folders(spark, d):
    """Nested training folders with the images in them."""
    return counting.cumulative_folders(table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("bucket")), "bucket", manifest.cumulative(100))


@query("""WITH c AS (SELECT p_brand, min(p_size % 5) AS first, count(*) AS n FROM part GROUP BY p_brand),
    m AS (SELECT *, row_number() OVER (ORDER BY first, p_brand) - 1 AS class_id FROM c)
    SELECT CAST(class_id AS INT) AS class_id, CASE WHEN class_id = 2 THEN 'Z' ELSE p_brand END AS name, n FROM m""")
def merged_classes(spark, d):
    """The class lists of five manifests as one, a class renamed, with what is in each."""
    rows = table(spark, d, "part").groupBy((F.col("p_size") % 5).alias("manifest"), "p_brand").agg(F.count("*").alias("n"))
    lists = rows.groupBy("manifest").agg(F.array_sort(F.collect_list("p_brand")).alias("names")).orderBy("manifest").collect()  # class lists of manifests
    merged = manifest.merge_classes([r.names for r in lists])
    names = manifest.renamed(merged, {2: "Z"})
    classes = spark.createDataFrame([(k, old, names[k]) for k, old in merged.items()], "class_id int, p_brand string, name string")
    return rows.join(classes, "p_brand").groupBy("class_id", "name").agg(F.sum("n").alias("n"))


# ---- round trips through files ---------------------------------------------------------------------------------------


@query("SELECT DISTINCT source AS dataset, 'train' AS split, concat('sets/', source, '/images') AS rel_path FROM documents UNION ALL SELECT 'one', 'val', 'one/images'")
def manifest_paths(spark, d):
    """A1, A3, A4, B1: a manifest written and read; its data sets are few."""
    found = sorted(r[0] for r in table(spark, d, "documents").select("source").distinct().collect())
    text = manifest.dump({0: "A", 1: "N"}, {"train": [f"sets/{s}/images" for s in found], "val": "one/images"}, "/data")
    path = scratch(spark)
    manifest.write(spark, text, path)
    return manifest.read(spark, path)[0]


def _quads(spark, d) -> DataFrame:
    v = view(spark, d, "v_quads")
    ring = G.box_polygon(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return v.select("stem", "class_id", ring.alias("coords"), "area")


@query("SELECT CAST(stem AS VARCHAR) AS stem, class_id, count(*) AS n, sum(area) AS area FROM v_quads GROUP BY stem, class_id")
def label_files(spark, d):
    """Label files written, read and measured."""
    path = scratch(spark)
    sinks.write_labels(_quads(spark, d), path)
    rows = read.label_lines(spark, path)
    stem = F.regexp_extract("path", "stem=([^/]+)/", 1).alias("stem")
    return rows.groupBy(stem, "class_id").agg(F.count("*").alias("n"), F.sum(G.polygon_area(F.col("coords"))).alias("area"))


@query("""SELECT CASE l_linenumber % 3 WHEN 0 THEN 'box' ELSE 'polygon' END AS kind, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1""")
def ground_truth_files(spark, d):
    """Boxes and polygons of label files; shorter lines go."""
    k = F.col("l_linenumber") % 3
    line = F.when(k == 0, "1 0.1 0.2 0.3 0.4").when(k == 1, "1 0.1 0.2 0.3 0.4 0.5 0.6").otherwise("1 0.1 0.2")
    path = scratch(spark)
    table(spark, d, "lineitem").select(line.alias("value")).write.text(path)
    return read.ground_truth(spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT CAST(stem AS VARCHAR) AS stem, md5(string_agg(concat_ws(' ', class_id, x1, y1, x2, y1, x2, y2, x1, y2), chr(10)
    ORDER BY concat_ws(' ', class_id, x1, y1, x2, y1, x2, y2, x1, y2))) AS text FROM v_quads WHERE area >= 900 GROUP BY stem""")
def label_texts(spark, d):
    """The text of each filtered label file; files without a line don't appear."""
    kept = _quads(spark, d).where("area >= 900").withColumn("stem", F.col("stem").cast("string"))
    return sinks.label_table(kept, ["stem"]).select("stem", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT line, count(*) AS n FROM (SELECT concat_ws(' ', x1, y1, x2, y2, class_id, conf) AS line FROM v_preds) GROUP BY line")
def box_lines(spark, d):
    """Predictions as text lines, boxes."""
    path = scratch(spark)
    sinks.predictions_text(view(spark, d, "v_preds"), path, boxes=True)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT line, count(*) AS n FROM (SELECT concat_ws(' ', class_id, x1, y1, x2, y1, x2, y2, x1, y2, conf) AS line FROM v_preds) GROUP BY line")
def polygon_lines(spark, d):
    """Predictions as text lines, polygons."""
    path = scratch(spark)
    ring = G.box_polygon(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    sinks.predictions_text(view(spark, d, "v_preds").withColumn("coords", ring), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS image_id, n_name AS file_name, count(c_custkey) AS n, round(sum(c_acctbal), 2) AS area
    FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name""")
def coco_document(spark, d):
    """One COCO document written and read."""
    images = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("file_name"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("c_acctbal"), F.lit(1.0))
    anns = table(spark, d, "customer").select(
        F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("image_id"), F.lit(1).cast("long").alias("category_id"), box.alias("bbox"),
        F.col("c_acctbal").alias("area"), F.array(box).alias("segmentation"), F.lit(0).alias("iscrowd"),
    )
    path = scratch(spark)
    sinks.write_coco(images, anns, spark.createDataFrame([(1, "A")], "id long, name string"), path, tables=False, licence="none")
    found = read.coco(spark, path)
    joined = found["images"].select(F.col("id").alias("image_id"), "file_name").join(found["annotations"].select("image_id", "id", "area"), "image_id")
    return joined.groupBy("image_id", "file_name").agg(F.count("id").alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query("""SELECT n_name AS name, concat('w', CAST(s_suppkey % 3 AS VARCHAR)) AS label, count(*) AS n, CAST(sum(2 * (2 * s_suppkey + 7)) AS DOUBLE) AS total
    FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def cvat_document(spark, d):
    """Polygons written as XML and read."""
    k = F.col("s_suppkey").cast("double") + 1
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").cast("long").alias("image_id"), F.col("n_name").alias("name"), F.lit(10).alias("width"), F.lit(20).alias("height"),
        F.concat(F.lit("w"), (F.col("s_suppkey") % 3).cast("string")).alias("label"), F.array(k, k + 5, k + 5, k).alias("coords"),
    )
    path = scratch(spark)
    sinks.write_cvat(rows, path)
    back = read.cvat_polygons(read.cvat(spark, path))
    total = F.aggregate("coords", F.lit(0.0), lambda a, c: a + c)
    return back.groupBy("name", "label").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query("SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS top, CAST(2 AS BIGINT) AS n_points FROM supplier")
def roi_tables(spark, d):
    """Tab-separated regions whose cells hold lines."""
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), k.alias("top"), F.concat(k, F.lit(" 1\n"), k, F.lit(" 2")).alias("integer_coordinates"))
    path = scratch(spark)
    sinks.write_rois(rows, path)
    return read.rois(spark, path).select("name", "top", F.size(N.point_lines(F.col("integer_coordinates"))).cast("long").alias("n_points"))


@query("SELECT run, count(*) AS n, round(sum(map50), 6) AS total FROM v_results GROUP BY run")
def training_logs(spark, d):
    """A17."""
    path = scratch(spark)
    v = view(spark, d, "v_results").select("epoch", F.col("map50").alias("metrics/mAP50(M)"), "run")
    sinks.write_table(v, path)
    log = read.training_log(spark, path)
    return log.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("`metrics/mAP50(M)`"), 6).alias("total"))


@query("SELECT train_size, count(*) AS n, round(avg(map50), 6) AS mean FROM v_results GROUP BY train_size")
def result_files(spark, d):
    """Rows appended to result files, some columns read; a file that lacks one is left out."""
    v = view(spark, d, "v_results").withColumn("conf", F.col("conf").cast("double"))
    one, other, odd = (scratch(spark) for _ in range(3))
    sinks.append_results(v.where("run = 0"), one)
    sinks.append_results(v.where("run = 1"), one)
    sinks.append_results(v.where("run = 2"), other)
    sinks.append_results(v.select("epoch").limit(3), odd)
    rows = read.results(spark, [one, odd, other], ["train_size", "map50"])
    return rows.groupBy("train_size").agg(F.count("*").alias("n"), F.round(F.avg("map50"), 6).alias("mean"))


@query("SELECT rel_path, count(*) AS n FROM (SELECT image_path AS rel_path FROM v_image_paths) GROUP BY rel_path")
def train_lists(spark, d):
    """Lists of names written and read."""
    path = scratch(spark)
    view(spark, d, "v_image_paths").select(F.concat(F.lit(" "), "image_path", F.lit("  ")).alias("value")).write.text(path)
    return read.train_list(spark, path).groupBy("rel_path").agg(F.count("*").alias("n"))


@query("SELECT class_id, n, area FROM (SELECT class_id, count(*) AS n, round(avg({0}), 4) AS area FROM v_labels GROUP BY class_id)".format(AREA))
def metric_files(spark, d):
    """A table of metrics written as delimited text and read."""
    v = view(spark, d, "v_labels").withColumn("a", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    path = scratch(spark)
    sinks.write_table(v.groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("area")), path)
    return spark.read.csv(path, header=True, schema="class_id int, n long, area double")


@query("SELECT concat('stem=', CAST(l_suppkey AS VARCHAR)) AS folder FROM lineitem GROUP BY l_suppkey")
def listed_files(spark, d):
    """Listings of written files, contents unread."""
    path = scratch(spark)
    sinks.write_labels(_quads(spark, d), path)
    found = read.listing(spark, [path], ("TXT",), any_case=True).where("length > 0")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


__all__ = ["files"]
