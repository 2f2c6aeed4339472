"""Input views over the test tables: each one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_images": """
        SELECT o_orderkey AS image_id, CAST(1280 + 320 * (o_orderkey % 5) AS BIGINT) AS width,
               CAST(960 + 112 * (o_custkey % 7) AS BIGINT) AS height, o_orderpriority AS dataset, o_orderstatus AS split
        FROM orders""",
    "v_labels": """
        SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_linenumber,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
               CAST((37 * l_partkey) % 1000 AS DOUBLE) AS x1, CAST((53 * l_suppkey + 17 * l_linenumber) % 800 AS DOUBLE) AS y1,
               CAST((37 * l_partkey) % 1000 AS DOUBLE) + 10 + l_quantity AS x2,
               CAST((53 * l_suppkey + 17 * l_linenumber) % 800 AS DOUBLE) + 10 + (l_partkey % 40) AS y2,
               l_discount + 0.0 AS discount, l_extendedprice AS price
        FROM lineitem""",
    "v_thresholds": """
        SELECT CAST(class_id AS INT) AS class_id, CAST(min_area AS DOUBLE) AS min_area
        FROM (VALUES (0, 400.0), (1, 700.0), (2, 1000.0)) AS t(class_id, min_area)""",
    "v_preds": """
        SELECT image_id, l_partkey, l_suppkey, l_linenumber, price,
               CASE WHEN l_partkey % 17 = 0 THEN 2 - class_id ELSE class_id END AS class_id,
               10 * discount AS conf, x1 + (l_suppkey % 5) AS x1, y1 + (l_linenumber % 4) AS y1,
               x2 + (l_suppkey % 5) AS x2, y2 + (l_linenumber % 4) AS y2
        FROM v_labels WHERE (l_partkey + l_suppkey) % 10 <> 0
        UNION ALL
        SELECT image_id, l_partkey, l_suppkey, l_linenumber, price, class_id, 10 * discount AS conf,
               x1 + 5000 AS x1, y1 AS y1, x2 + 5000 AS x2, y2 AS y2
        FROM v_labels WHERE l_partkey % 23 = 0""",
    "v_pairs": """
        SELECT image_id, class_id AS true_label,
               CASE WHEN l_partkey % 7 = 0 THEN 3 WHEN l_suppkey % 11 = 0 THEN (class_id + 1) % 3 ELSE class_id END AS pred_label
        FROM v_labels""",
    "v_files": """
        SELECT o_orderkey, CASE
          WHEN o_orderkey % 29 = 0 THEN concat('IMG', CAST(o_orderkey AS STRING), '.jpg')
          WHEN o_orderkey % 13 = 0 THEN concat(CAST(o_orderkey AS STRING), '-', CAST(o_custkey % 9 AS STRING), '-2-',
               CAST(o_custkey % 20 AS STRING), '-4-', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), '-0930.jpg')
          ELSE concat('SITE_S', CAST(o_custkey % 5 AS STRING), '_R', CAST(o_custkey % 3 AS STRING), '_',
               CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING), '_w',
               CAST(o_orderkey % 12 AS STRING), '_T', lpad(CAST(o_custkey % 20 AS STRING), 2, '0'), '_',
               lpad(CAST(o_orderkey % 30 AS STRING), 2, '0'), '.jpg') END AS filename
        FROM orders""",
    "v_state": """
        SELECT d.doc_id AS image_id, d.source AS dataset, d.lang AS split,
               CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'non_empty' ELSE 'empty' END AS state
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_results": """
        SELECT event_id AS epoch, 10 * (1 + user_id % 10) AS train_size,
               CASE event_type WHEN 'click' THEN 0.001 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.5 ELSE 0.7 END AS conf,
               value / 500 AS map50, value * 60 AS total_train_time, event_id % 3 AS run
        FROM events""",
    "v_groups": "SELECT c_nationkey AS value, c_mktsegment AS stratum, c_custkey AS image_id FROM customer",
    "v_coco_images_base": """
        SELECT doc_id AS id, concat(source, '/', CAST(doc_id AS STRING), '.jpg') AS file_name FROM documents""",
    "v_coco_images_add": """
        SELECT doc_id + 100000 AS id, concat('other/', CASE WHEN lang = 'es' THEN 'only_' ELSE '' END, CAST(doc_id AS STRING), '.jpg') AS file_name
        FROM documents""",
    "v_coco_cats_base": "SELECT * FROM (VALUES (5, 'A'), (6, 'N'), (7, 'R')) AS t(id, name)",
    "v_coco_cats_add": "SELECT * FROM (VALUES (1, 'R'), (2, 'X')) AS t(id, name)",
    "v_coco_anns_base": """
        SELECT image_id * 1000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, image_id,
               5 + class_id AS category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, price,
               l_partkey % 19 = 0 AS no_box, l_suppkey % 21 = 0 AS no_segments
        FROM v_labels""",
    "v_coco_anns_add": """
        SELECT doc_id * 10 AS id, doc_id + 100000 AS image_id, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS category_id,
               CAST(doc_id % 50 AS DOUBLE) AS x1, CAST(doc_id % 70 AS DOUBLE) AS y1, 10.0 AS w, 20.0 AS h, 0.0 AS price,
               FALSE AS no_box, FALSE AS no_segments
        FROM labels""",
}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def needs(text: str) -> list[str]:
    """The views that a query reads, those they read in turn first."""
    out: list[str] = []
    for name, body in VIEWS.items():
        if f"{name} " in f"{text} ".replace("\n", " ").replace(")", " ").replace(",", " "):
            out += [x for x in [*needs(body), name] if x not in out]
    return out


def twin(sql: str) -> str:
    """A DuckDB query with the views that it reads in front."""
    names = needs(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not head:
        return sql
    body = sql.strip()
    if body[:4].upper() == "WITH":
        body = body[4:].lstrip()
        recursive = body[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' * recursive}{head}, {body[9:] if recursive else body}"
    return f"WITH {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are read with the columns that it needs."""
    return _sql(spark, sf_dir, VIEWS[name], {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, done: dict[str, DataFrame]) -> DataFrame:
    used = {}
    for name in [*VIEWS, *TABLES]:
        if f" {name} " in f" {text} ".replace("\n", " ").replace(")", " "):
            used[name] = _sql(spark, sf_dir, VIEWS[name], done) if name in VIEWS else table(spark, sf_dir, name)
    for name in used:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **used)
