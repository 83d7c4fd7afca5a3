"""Tables that grow with a graph are not broadcast, however small they are estimated."""

from pyspark.sql import functions as F

from strandlake.operators import graph as g


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_not_broadcast(spark):
    # a few rows of a column of one file; each is many edges, of which the estimate knows nothing
    k = spark.range(4).select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("j")).select((F.col("id") * 100 + F.col("j")).alias("n"))
    edges = g.checkpointed(k.select(F.col("n").alias("node1"), F.lit(0).alias("dir1"), (F.col("n") + 1).alias("node2"), F.lit(0).alias("dir2"), F.lit(1).alias("cov"), F.lit(0).alias("off"), F.lit(0).alias("closed")))
    assert "BroadcastHashJoin" not in plan(g.linear_steps(edges))
    paths = g.unitigs(edges, g.degrees(edges).select("node"))
    assert "BroadcastHashJoin" not in plan(paths) and paths.count() == 401


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    other = spark.range(1000)
    with g.Tables(spark) as keep:
        assert "BroadcastHashJoin" in plan(other.join(keep(spark.range(100)), "id"))
        monkeypatch.setattr(g.Tables, "SMALL_TABLE", 0)
        t = keep(spark.range(100))
        assert "BroadcastHashJoin" not in plan(other.join(t.groupBy("id").agg(F.count("*").alias("n")), "id"))
        assert t.count() == 100
