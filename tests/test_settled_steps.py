"""Derived values are worked out once, and not again inside the conditions on them."""

from boxloom.operators.relations import region_relations
from boxloom.queries import fixtures as fx

SF = "/root/testdata/sf0.001"


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]


def test_conditions_on_regions_read_values(spark):
    asked = fx.regions(spark, SF).where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND region_id IS NOT NULL")
    assert not [line for line in filters(asked) if "l_partkey" in line or "l_suppkey" in line or "l_quantity" in line]


def test_conditions_on_relations_read_values(spark):
    edges = region_relations(fx.regions(spark, SF)).where("primary_rel <> 'near_equal'")
    # of the ladder of relations no condition holds a copy
    assert not [line for line in filters(edges) if "0.95" in line]


def test_stages_too_large_for_the_jvm_compiler_are_split(spark):
    fx.regions(spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
