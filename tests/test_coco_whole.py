"""The COCO queries read whole tables."""

from quadrat.plans.catalogue import QUERIES
from quadrat.plans.views import table, view

SF = "/root/testdata/sf0.001"


def test_all_rows(spark):
    sizes = {r.part: r.n for r in QUERIES["coco_sizes"](spark, SF).collect()}
    n = {t: table(spark, SF, t).count() for t in ("documents", "lineitem", "labels")}
    assert sizes["images"] == n["documents"] and sizes["annotations"] == n["lineitem"]
    assert QUERIES["coco_stats"](spark, SF).first().total == n["lineitem"]
    assert view(spark, SF, "v_coco_images_add").count() == n["documents"] and view(spark, SF, "v_coco_anns_add").count() == n["labels"]
    assert {r.side for r in QUERIES["coco_merge"](spark, SF).collect()} == {"base", "extra"}
