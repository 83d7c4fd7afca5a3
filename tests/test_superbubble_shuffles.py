"""A round of the searches for superbubbles shuffles what is walked on and the steps, and once by entrance what is met."""

from strandlake.operators import graph as g
from strandlake.operators import local
from strandlake.plans import queries as q


def test_a_round_has_three_shuffles(spark, monkeypatch):
    plans = []

    class Watched(g.Tables):
        SMALL_TABLE = 0

        def __call__(self, df):
            plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
            return super().__call__(df)

    monkeypatch.setattr(local, "Tables", Watched)
    assert q.superbubbles(spark, "/root/testdata/sf0.001").count() > 100
    rounds = [(c, p.count("Exchange")) for c, p in plans if "n_ready" in c or c[:3] == ["entrance", "s", "t"]]
    assert len(rounds) > 4 and all(n <= (1 if "n_ready" in c else 2) for c, n in rounds), rounds
