"""Tasks that join lines with their orders must not get larger as lines get more."""

from pyspark.sql import functions as F

from quarry import registry
from quarry.plans import machines
from quarry.plans.book import Tables


def test_tasks_follow_lines(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, registry.queries()["ranked_systems"](spark, sf_dir).collect()))
    t = Tables(spark, sf_dir)
    n = t.lineitem.count()
    monkeypatch.setattr(machines, "SHARE", n // 12)
    facts = machines.dimension_facts(t)[1].where("dimension = 'hub'")
    held = [r["count"] for r in facts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == n and max(held) < n // 6
    assert sorted(map(tuple, registry.queries()["ranked_systems"](spark, sf_dir).collect())) == whole
