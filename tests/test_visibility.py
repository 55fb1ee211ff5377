"""The membership fan-out: every pair, and in an order that keeps the written result small."""

import pandas as pd

from jobsight.operators import joins as J


def frames(spark, rows, users):
    queues = spark.createDataFrame([(q, q % 3 if q % 7 else None) for q in range(40)], "queue_id long, project_id long")
    projects = spark.createDataFrame([(0, 10), (1, 10), (2, None)], "project_id long, org_id long")
    members = spark.createDataFrame(users, "org_id long, user_id long")
    return spark.createDataFrame(rows, "id long, queue_id long"), queues, projects, members


def test_pairs_with_repeated_and_null_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "FAN_TILE", 3)
    rows = [(i % 50, i % 45) for i in range(120)] + [(None, 1), (None, 1), (7, None)] + [(3, 4)] * 9
    users = [(10, u) for u in range(8)] + [(10, 2), (10, None), (11, 4), (None, 5)]
    got = J.visible_to(*frames(spark, rows, users))
    assert got.columns == ["org_id", "id", "queue_id", "project_id", "user_id"]
    want = [(10, i, q, q % 3, u) for i, q in rows if q is not None and q < 40 and q % 7 and q % 3 < 2 for o, u in users if o == 10]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_members_change_once_a_tile(spark):
    """A result whose last member changes with every row does not compress."""
    rows, users = [(i, 1 + i % 2 * 2) for i in range(2560)], [(10, u) for u in range(100)]
    got = J.visible_to(*frames(spark, rows, users)).select("user_id")

    def changes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "changes": [int((f.user_id.diff() != 0).sum())]})

    x = got.mapInPandas(changes, "n long, changes long").toPandas().sum()
    assert x.n == 2560 * 100 and x.changes < x.n / 10
