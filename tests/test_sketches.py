"""Daily author sketches merged to longer periods against exact counts."""

import datetime as dt

from codeloom.operators import aggregates as A


def test_merged_sketches_stay_within_their_error(spark):
    rows = [("r", f"a{(i * 7919) % 9000}@x", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 1400)) for i in range(30_000)]
    rows += [("s", "one@x", dt.datetime(2024, 5, 1)), ("s", "one@x", dt.datetime(2024, 6, 1)), ("s", None, dt.datetime(2024, 6, 2)), ("s", "two@x", None)]
    c = spark.createDataFrame(rows, "repository_id string, author_email string, author_ts timestamp")
    daily = A.activity_sketches(c)
    first, late = daily.where("day < '2024-01-20'"), daily.where("day >= '2024-01-20'")
    for table in (daily, first.unionByName(late)):
        got = {r.repository_id: (r.n_commits, r.contributors) for r in A.activity_between(table).collect()}
        assert got["s"] == (3, 1) and got["r"][0] == 30_000
        assert abs(got["r"][1] - 9000) < 0.08 * 9000
    exact = {}
    for repo, who, at in rows:
        if at:
            exact.setdefault((repo, at.replace(day=1).date()), set()).update({who} - {None})
    months = {(r.repository_id, r.period): r.contributors for r in A.activity_between(daily, "month").collect()}
    assert months.keys() == exact.keys() and all(abs(n - len(exact[k])) <= 0.08 * len(exact[k]) for k, n in months.items())
