"""The stored layout: pruned folders, no exchange below the joins, the same features."""

import re

from stayrate.plans.catalogue import AS_OF
from stayrate.plans.frames import Signals
from stayrate.session import scratch_path
from stayrate.sources.fixtures import FixtureTables
from stayrate.sources.layout import LayoutTables, write_layout


def test_features_read_their_months_and_move_no_rows(spark, sf_dir):
    tables = FixtureTables(spark, sf_dir)
    write_layout(tables, scratch_path(spark, "layout"), "retention_layout", buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        features = Signals(LayoutTables(spark, "retention_layout"), AS_OF).final()
        plan = features._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 4
        scans = re.findall(r"PartitionFilters: \[[^\]]*month[^\]]*>=[^\]]*\]", plan)
        assert len(scans) >= 2  # usage and tickets are bounded on both sides
        assert "SelectedBucketsCount: 3 out of 3" in plan or "Bucketed: true" in plan
        found = {r.customer_id: r for r in features.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = {r.customer_id: r for r in Signals(tables, AS_OF).final().collect()}
    assert found == expected and found
