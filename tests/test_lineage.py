import os

import pytest
from pyspark.sql import functions as F

from quarry import lineage
from quarry.operators import components


def tables(spark):
    at = lineage.shared_dir(spark).removeprefix("file://") + "/quarry"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_owned_tables_go_at_the_end(spark):
    kept = lineage.cut(spark.range(5), "kept")
    before = tables(spark)
    edges = spark.range(50).select(F.col("id").alias("src"), (F.col("id") / 2).cast("long").alias("dst"))
    with lineage.owned(spark):
        inner = lineage.cut(spark.range(3), "inner")
        with lineage.owned(spark):
            lineage.cut(spark.range(2), "innermost").count()
        assert inner.count() == 3 and any(t.startswith("inner-") for t in tables(spark)) and not any(t.startswith("innermost-") for t in tables(spark))
        found = components.connected_components(edges).collect()
        assert tables(spark) > before
    assert tables(spark) == before and kept.count() == 5 and len(found) == 50


def test_they_go_when_the_work_fails(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), lineage.owned(spark):
        lineage.cut(spark.range(3), "lost")
        raise ZeroDivisionError
    assert tables(spark) == before
    lineage.remove(spark, lineage.shared_dir(spark) + "/quarry/never-was")
