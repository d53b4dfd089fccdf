"""Plan shape: no pair-producing joins, stable results across partition counts."""

from skillweave.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop(spark):
    for name in ["spans", "extractor_overlap", "requirements", "validation_report"]:
        p = _plan(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_filters_and_columns_reach_the_scan(spark):
    p = _plan(registry.QUERIES["dense_matches"](spark, SF))
    assert "ReadSchema" in p


def test_same_result_with_one_and_many_partitions(spark):
    spark.catalog.clearCache()
    registry._FLOWS.clear()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, registry.QUERIES["requirements"](spark, SF).collect()))
    spark.catalog.clearCache()
    registry._FLOWS.clear()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(tuple, registry.QUERIES["requirements"](spark, SF).collect()))
    assert a == b and len(a) > 0


def test_no_exchange_carries_a_text(spark, tmp_path):
    """The text of adverts is read, scanned and dropped in the same stage. The input has more splits than a handful (a
    smaller one is dealt out first) and fewer than there are cores to many times over."""
    import re
    for name in ("documents", "benchmark"):
        n = 12 if name == "documents" else 1
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.catalog.clearCache()
    registry._FLOWS.clear()
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # small files are splits of their own
    try:
        for name in ["spans", "mappings", "requirements"]:
            df = registry.QUERIES[name](spark, str(tmp_path))
            df.collect()
            plan = df._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            exchanges = re.findall(r"\(\d+\) Exchange\n(?:.*\n)*?\n", plan)
            assert exchanges
            for node in exchanges:
                assert "raw_text" not in node, name
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        registry._FLOWS.clear()


def test_one_flow_is_kept_and_the_one_before_freed(spark):
    registry._FLOWS.clear()
    spark.catalog.clearCache()
    first = registry.flow(spark, SF)
    first.facts.count()
    assert registry.flow(spark, SF) is first and spark.sparkContext._jsc.getPersistentRDDs()
    second = registry.flow(spark, "/root/testdata/sf0.01")
    assert second is not first and len(registry._FLOWS) == 1
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert first.facts.count() > 0  # a table of it still works
    registry._FLOWS.clear()
