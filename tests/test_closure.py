"""The recursive closure has no bound of rows or levels of its own."""

from meridian.plans import registry

SF = "/root/testdata/sf0.001"


def test_closure_beyond_the_session_bounds(spark):
    want = {(r.id, r.anc) for r in registry.QUERIES["ancestor_closure"](spark, SF).collect()}
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "1")
    try:
        got = [(r.id, r.anc) for r in registry.QUERIES["recursive_closure"](spark, SF).collect()]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")
    assert len(got) > 100 and len(got) == len(set(got)) and set(got) == want
