from semql.functions.embedders import HashingEmbedder
from semql.operators.scan import Match, VectorTable


def test_counters_wait_for_searches_that_have_run(spark):
    """Spark tells of a job's counts later than the job ends; read at once they were missing."""
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(50)], "i long, v array<float>").repartition(8)
    for _ in range(5):
        source = VectorTable(rows, {"v": "v"}, HashingEmbedder(), rowid="i", threshold=1.5, counted=True)
        source.scan(Match("v", [1.0, 1.0], "exact")).write.format("noop").mode("overwrite").save()
        source.metrics.settle(ran=True)
        counts = source.metrics.snapshot()
        assert (counts["candidates"], counts["rows_matched"]) == (50, 25)
