"""Next fire by field successors: against listed occurrences, over offset changes, rare calendars."""

import datetime as dt
import itertools
import random

import pytest

from jobsight.operators import cron as C

ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca"]
# Around gaps and repeated hours of these zones, ends of months and of a leap February.
NOWS = ["2024-03-10 06:59:59", "2024-03-10 07:00:00.5", "2024-11-03 05:29:30", "2024-11-03 06:10:00",
        "2024-03-31 00:59:59", "2024-10-27 00:30:00", "2024-10-27 01:15:00", "2024-10-05 15:15:00",
        "2024-04-06 15:10:00", "2024-02-28 23:59:59", "2023-12-31 23:59:59", "2024-04-14 02:00:00"]


def _schedules(spark, crons, zones):
    rows = [(i, c, z) for i, (c, z) in enumerate(itertools.product(crons, zones))]
    return spark.createDataFrame(rows, "schedule_id long, cron_expr string, timezone string"), rows


def _random_crons(n, seed):
    r = random.Random(seed)

    def field(lo, hi):
        return r.choice(["*", "*", str(r.randint(lo, hi)), f"{r.randint(lo, lo + 2)}-{r.randint(lo + 3, hi)}",
                         f"*/{r.randint(2, 9)}", f"{r.randint(lo, hi)},{r.randint(lo, hi)}"])

    return [" ".join([r.choice(["0", "*/20", "7,59"]), field(0, 59), r.choice(["*", "1-3", "*/2", "2", "1,23"]),
                      field(1, 28), "*", r.choice(["*", "*", "1", "MON-FRI"])]) for _ in range(n)]


@pytest.mark.parametrize("now", NOWS)
def test_first_of_the_listed_occurrences(spark, now):
    crons = _random_crons(6, now) + ["0 30 2 * * *", "0 0/10 1-3 * * *", "59 59 23 * * *", "* * * * * *", "0 15 2 29 2 *"]
    s, rows = _schedules(spark, crons, ZONES)
    end = dt.datetime.fromisoformat(now) + dt.timedelta(days=3)
    after = dt.datetime.fromisoformat(now).replace(microsecond=0) + dt.timedelta(seconds=1)
    listed, _ = C.occurrences(s, after, end)
    want = {r.schedule_id: r.f for r in listed.groupBy("schedule_id").agg({"fire_time": "min"}).toDF("schedule_id", "f").collect()}
    got = {r.schedule_id: r.next_fire_at for r in C.next_fire(s, now).collect()}
    assert {i: f for i, f in got.items() if f < end} == want, rows
    assert len(want) > len(rows) / 3


def test_rare_calendars(spark):
    crons = ["* * * * 6 *", "0 0 0 29 2 1", "0 0 0 30 2 *", "0 0 12 31 * * 2099", "0 0 0 1 1 * 2000", "0 0 0 13 * 6", "59 59 23 31 12 * 2099"]
    s, rows = _schedules(spark, crons, ["UTC"])
    got = {rows[r.schedule_id][1]: str(r.next_fire_at) for r in C.next_fire(s, "2024-07-01 00:00:00").collect()}
    assert got == {"* * * * 6 *": "2025-06-01 00:00:00", "0 0 0 29 2 1": "2032-02-29 00:00:00",
                   "0 0 12 31 * * 2099": "2099-01-31 12:00:00", "0 0 0 13 * 6": "2024-09-13 00:00:00",
                   "59 59 23 31 12 * 2099": "2099-12-31 23:59:59"}


def test_only_fire_of_each_year_in_a_gap(spark):
    """Second Sunday of March, 2:30 in New York, never exists; at 3:00 the gap has just ended."""
    s, rows = _schedules(spark, ["0 30 2 8-14 3 1", "0 30/30 2-3 8-14 3 1"], ["America/New_York"])
    got = {rows[r.schedule_id][1]: str(r.next_fire_at) for r in C.next_fire(s, "2024-01-01 00:00:00").collect()}
    assert got == {"0 30/30 2-3 8-14 3 1": "2024-03-10 07:30:00"}


def test_a_day_that_a_zone_left_out(spark):
    """Samoa had no 30 December 2011: the next noon is a day later."""
    s, _ = _schedules(spark, ["0 0 12 30,31 * *"], ["Pacific/Apia"])
    assert [str(r.next_fire_at) for r in C.next_fire(s, "2011-12-01 00:00:00").collect()] == ["2011-12-30 22:00:00"]


def test_plan_lists_nothing(spark):
    s, _ = _schedules(spark, ["* * * * 6 *"], ["UTC"])
    plan = C.next_fire(s, "2024-07-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
