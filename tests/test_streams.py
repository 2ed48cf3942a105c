from tessera import catalog
from tessera.registry import table

SF = "/root/testdata/sf0.001"
NAME = "stream_source_rate_and_memory"


def test_memory_sink_holds_one_row(spark):
    got = catalog.queries()[NAME](spark, SF).collect()
    assert [r.n for r in got] == [table(spark, SF, "events").count()]
    assert spark.table("tessera_memory").count() == 1


def test_memory_sink_of_no_rows(spark, tmp_path):
    table(spark, SF, "events").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.n for r in catalog.queries()[NAME](spark, str(tmp_path)).collect()] == [0]
