"""Cron calendar (C2–C4): six-field cron expressions (seconds first, optional
year) expanded into fire times on the executors with built-in expressions.

Each field becomes a sorted array of allowed values (``*``, ``?``, ``a``,
``a-b``, ``*/n``, ``a/n``, ``a-b/n``, lists, month and weekday names). Days come
from ``sequence`` over the window, filtered by day-of-month, month, weekday (both
day fields must match; Sunday = 1) and year; each kept day is crossed with the
schedule's times of day as **local** wall-clock time, then converted to UTC.
A local time that does not exist (DST gap) fails the round trip and is skipped;
an ambiguous local time maps to its earlier instant. The next fire (C3) needs no days
or times: it is the successor of an instant, field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as G
from ..session import ts
from .merge import insert_ignore

# ---- fixed values (cron field domains and names) -------------------------------
FIELDS = [("sec", 0, 59), ("min", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12),
          ("dow", 1, 7), ("year", 1970, 2099)]
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DOW_NAMES = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
# -------------------------------------------------------------------------------

def _field_sql(tok: str, lo: int, hi: int) -> str:
    """SQL text: the sorted allowed values of the field ``tok``, null where it is
    malformed (one bad item makes the whole list null)."""
    num = lambda pattern: f"try_cast(nullif(regexp_extract(it, r'{pattern}', 1), '') AS INT)"
    part = f"""it -> named_struct('ok', it RLIKE r'^(?:[*?]|\\d+(?:-\\d+)?)(?:/\\d+)?$', 'star', it RLIKE r'^[*?]',
        'stepped', contains(it, '/'), 'a', {num('^(\\d+)')}, 'b', {num('-(\\d+)')}, 's', {num('/(\\d+)$')})"""
    bounds = f"""r -> named_struct('ok', r.ok, 'a', CASE WHEN r.star THEN {lo} ELSE r.a END,
        'b', CASE WHEN r.star OR (r.stepped AND r.b IS NULL) THEN {hi} ELSE coalesce(r.b, r.a) END,
        's', CASE WHEN r.stepped THEN r.s ELSE 1 END)"""
    values = f"r -> CASE WHEN r.ok AND r.s >= 1 AND r.a >= {lo} AND r.b <= {hi} AND r.a <= r.b THEN sequence(r.a, r.b, r.s) END"
    return f"array_sort(array_distinct(flatten(transform(transform(transform(split({tok}, ','), {part}), {bounds}), {values}))))"


def _named_sql(tok: str, names: list[str]) -> str:
    """SQL text: month or weekday names of ``tok`` as numbers; only fields with letters."""
    out = f"upper({tok})"
    for i, name in enumerate(names):
        out = f"regexp_replace({out}, r'\\b{name}\\b', '{i + 1}')"
    return f"CASE WHEN {tok} RLIKE '[A-Za-z]' THEN {out} ELSE {tok} END"


def parse_cron(expr: str) -> Column:
    """struct(sec, min, hour, dom, month, dow, year) of the cron text in column ``expr``;
    a field is null where it is malformed or missing. Written as SQL text: one expression
    to parse instead of thousands of calls to build it."""
    toks = f"split(trim({expr}), r'\\s+')"
    fields = []
    for i, (name, lo, hi) in enumerate(FIELDS):
        tok = f"CASE WHEN size({toks}) IN (6, 7) THEN get({toks}, {i}) END" if i < 6 else \
            f"CASE WHEN size({toks}) = 7 THEN get({toks}, 6) ELSE '*' END"
        if name in ("month", "dow"):
            tok = _named_sql(tok, MONTH_NAMES if name == "month" else DOW_NAMES)
        fields.append(f"'{name}', {_field_sql(tok, lo, hi)}")
    return F.expr(f"named_struct({', '.join(fields)})")


def zone_ok(tz: Column) -> Column:
    """True when the JVM knows the zone id (built-in reflection, NULL on error)."""
    return F.coalesce(F.call_function("try_reflect", F.lit("java.time.ZoneId"), F.lit("of"), tz).isNotNull(),
                      F.lit(False))


def parsed_pairs(schedules: DataFrame, cron_col: str = "cron_expr", tz_col: str = "timezone") -> DataFrame:
    """One row per distinct (cron text, zone): ``__ce, __tz, __cron, __tz_ok``. All
    calendar work is done once per pair; the exchange keeps the parsing from being
    repeated in every later expression."""
    pairs = schedules.filter(F.col(cron_col).isNotNull()) \
        .select(F.col(cron_col).alias("__ce"), F.col(tz_col).alias("__tz")).distinct()
    parsed = pairs.withColumn("__cron", parse_cron("__ce")).withColumn("__tz_ok", zone_ok(F.col("__tz"))) \
        .repartition("__ce", "__tz")
    return parsed.withColumn("__ok", reduce(lambda a, b: a & b, [F.col(f"__cron.{f}").isNotNull() for f, _, _ in FIELDS]))


def _per_schedule(schedules: DataFrame, pairs: DataFrame, cron_col: str, tz_col: str) -> DataFrame:
    """Each schedule with its pair's rows."""
    return schedules.join(pairs, (F.col(cron_col) == F.col("__ce")) & F.col(tz_col).eqNullSafe(F.col("__tz")))


# C2 ---------------------------------------------------------------------------
def _day_matches(c: Column, day: Column) -> Column:
    return (F.array_contains(c["month"], F.month(day)) & F.array_contains(c["dom"], F.dayofmonth(day))
            & F.array_contains(c["dow"], F.dayofweek(day)) & F.array_contains(c["year"], F.year(day)))


def _fires(good: DataFrame, days: Column, t0: Column, t1: Column) -> DataFrame:
    """Explode candidate local days × times of day → UTC fire times in [t0, t1) per pair.

    The zone offset is looked up twice per day (at local midnight and at the
    next midnight); on the usual day without a transition every fire is local
    time minus that offset. Only on a transition day is each time converted and
    round-tripped (DST gap skipped, ambiguous → earlier instant)."""
    tz = F.col("__tz")
    c = F.col("__cron")
    tod = F.expr("flatten(transform(__cron.hour, h -> flatten(transform(__cron.min, "
                 "m -> transform(__cron.sec, x -> h * 3600 + m * 60 + x)))))")
    x = good.select("__ce", "__tz", "__cron", tod.alias("__tod"), F.explode(days).alias("__day"))
    x = x.filter(_day_matches(c, F.col("__day")))
    mid0 = F.col("__day").cast("timestamp")
    mid1 = F.date_add(F.col("__day"), 1).cast("timestamp")
    x = x.select("__ce", "__tz", "__tod", mid0.alias("__mid"),
                 (mid0 - F.to_utc_timestamp(mid0, tz)).alias("__off0"),
                 (mid1 - F.to_utc_timestamp(mid1, tz)).alias("__off1"))
    local = (x.select("__ce", "__tz", "__mid", "__off0", "__off1", F.explode("__tod").alias("__s"))
              .withColumn("__local", F.col("__mid") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                         F.col("__s").cast("decimal(18,6)"))))
    stable = F.col("__off0") == F.col("__off1")
    utc = F.when(stable, F.col("__local") - F.col("__off0")).otherwise(F.to_utc_timestamp(F.col("__local"), tz))
    local = local.withColumn("__utc", utc)
    exists = stable | (F.from_utc_timestamp(F.col("__utc"), tz) == F.col("__local"))
    return local.filter(exists & (F.col("__utc") >= t0) & (F.col("__utc") < t1)).select("__ce", "__tz", F.col("__utc").cast("timestamp_ntz").alias("fire_time"))


def occurrences(schedules: DataFrame, start, end, id_col: str = "schedule_id",
                cron_col: str = "cron_expr", tz_col: str = "timezone"):
    """Fire times in [start, end) (UTC wall clock) for every schedule with a cron
    expression. Returns (fires(id, fire_time, occurrence_key), rejects(id, reason))."""
    pairs = parsed_pairs(schedules, cron_col, tz_col)
    good = pairs.filter(F.col("__ok") & F.col("__tz_ok"))
    bad = pairs.filter(~F.col("__ok") | ~F.col("__tz_ok")).select(
        "__ce", "__tz", F.when(~F.col("__ok"), "bad_cron").otherwise("bad_timezone").alias("reason"))
    tz = F.col("__tz")
    t0, t1 = ts(start).cast("timestamp"), ts(end).cast("timestamp")
    d0 = F.date_sub(F.to_date(F.from_utc_timestamp(t0, tz)), 1)
    d1 = F.date_add(F.to_date(F.from_utc_timestamp(t1, tz)), 1)
    fires = _per_schedule(schedules, _fires(good, F.sequence(d0, d1, F.expr("INTERVAL 1 DAY")), t0, t1), cron_col, tz_col) \
        .select(id_col, "fire_time")
    rejects = _per_schedule(schedules, bad, cron_col, tz_col).select(id_col, "reason")
    return fires.withColumn("occurrence_key", G.occurrence_key(id_col, "fire_time")), rejects


# C3 ---------------------------------------------------------------------------
# Local and UTC times are whole seconds since 1970 here, so no session zone is involved.
def _let(value: str, name: str, body: str) -> str:
    """SQL text: ``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _to_local(utc: str) -> str:
    return f"unix_seconds(from_utc_timestamp(timestamp_seconds({utc}), __tz))"


def _to_utc(local: str) -> str:
    return f"unix_seconds(to_utc_timestamp(timestamp_seconds({local}), __tz))"


def _next_day(day: str) -> str:
    """SQL text: the first matching date at or after ``day``, null after the last year.
    Year, then month, then day carry; later values are not looked at once one is found."""
    in_month = f"""get(filter(transform(__cron.dom, k -> date_add(make_date(y, m, 1), k - 1)),
        x -> month(x) = m AND x >= {day} AND array_contains(__cron.dow, dayofweek(x))), 0)"""
    in_year = f"""aggregate(filter(__cron.month, m -> y > year({day}) OR m >= month({day})), CAST(NULL AS DATE),
        (found_m, m) -> coalesce(found_m, {in_month}))"""
    return f"""aggregate(filter(__cron.year, y -> y >= year({day})), CAST(NULL AS DATE),
        (found_y, y) -> coalesce(found_y, {in_year}))"""


def _next_time(sod: str) -> str:
    """SQL text: the first matching second of the day at or after ``sod``, null if none:
    in the same minute, else in the same hour, else in a later hour."""
    h, m, x = f"CAST({sod} div 3600 AS INT)", f"CAST({sod} div 60 % 60 AS INT)", f"{sod} % 60"
    return f"""CASE WHEN array_contains(__cron.hour, {h}) THEN coalesce(
            CASE WHEN array_contains(__cron.min, {m}) THEN {sod} div 60 * 60 + get(filter(__cron.sec, v -> v >= {x}), 0) END,
            {h} * 3600 + get(filter(__cron.min, v -> v > {m}), 0) * 60 + __cron.sec[0]) END"""


def _next_local(low: str) -> str:
    """SQL text: the first local time at or after ``low`` that matches all fields."""
    later_hour = """get(filter(__cron.hour, v -> v > sod div 3600), 0) * 3600 + __cron.min[0] * 60 + __cron.sec[0]"""
    today = f"coalesce({_next_time('sod')}, {later_hour})"
    first = "__cron.hour[0] * 3600 + __cron.min[0] * 60 + __cron.sec[0]"
    at = lambda d, t: f"unix_date({d}) * 86400L + {t}"
    return _let(f"date_from_unix_date(CAST(floor({low} / 86400D) AS INT))", "today",
                _let(_next_day("today"), "day",
                     f"""CASE WHEN day > today THEN {at('day', first)} ELSE coalesce(
                     {_let(f'pmod({low}, 86400L)', 'sod', at('day', today))},
                     {_let(_next_day('date_add(today, 1)'), 'following', at('following', first))}) END"""))


def _shift(lo: str, hi: str) -> str:
    """SQL text: the instant in (lo, hi] from which the zone's offset is that at ``hi``;
    one offset change lies between, at most a day wide."""
    mid = "(w.lo + w.hi) div 2"
    return f"""aggregate(sequence(1, 18), named_struct('lo', {lo}, 'hi', {hi}), (w, i) ->
        CASE WHEN {_to_local(mid)} - {mid} = {_to_local(hi)} - {hi}
             THEN named_struct('lo', w.lo, 'hi', {mid}) ELSE named_struct('lo', {mid}, 'hi', w.hi) END).hi"""


# Each further step of the search leaves an offset change behind; zones have at most four a year.
SEARCH_STEPS = 4 * (FIELDS[-1][2] - FIELDS[-1][1] + 1)


def _first_fire() -> Column:
    """Seconds of the first fire at or after ``__t0``, null if there is none. A local time
    that does not exist moves the search to the gap's end, one whose instant (the earlier
    of two) is past moves it to the end of the repeated span."""
    gap_end = _let(_shift(f"u - ({_to_local('u')} - t)", "u"), "g", f"g + {_to_local('u')} - u")
    repeat_end = f"{_shift('u', '__t0')} + t - u"
    state = lambda low, fire, done: f"named_struct('low', {low}, 'fire', {fire}, 'done', {done})"
    step = _let(_next_local("s.low"), "t", f"""CASE WHEN t IS NULL THEN {state('s.low', 'CAST(NULL AS BIGINT)', 'true')}
        ELSE {_let(_to_utc('t'), 'u', f"""CASE WHEN {_to_local('u')} <> t THEN {state(gap_end, 'CAST(NULL AS BIGINT)', 'false')}
            WHEN u < __t0 THEN {state(repeat_end, 'CAST(NULL AS BIGINT)', 'false')}
            ELSE {state('s.low', 'u', 'true')} END""")} END""")
    return F.expr(f"""aggregate(sequence(1, {SEARCH_STEPS}),
        {state(_to_local('__t0'), 'CAST(NULL AS BIGINT)', 'false')},
        (s, i) -> CASE WHEN s.done THEN s ELSE {step} END,
        s -> CASE WHEN s.done THEN s.fire ELSE raise_error('next fire: more offset changes than expected') END)""")


def next_fire(schedules: DataFrame, now, id_col: str = "schedule_id", cron_col: str = "cron_expr",
              tz_col: str = "timezone") -> DataFrame:
    """First fire strictly after ``now`` per valid cron schedule, up to the end of the
    year field's domain; a schedule without one has no row. Per distinct (cron, zone) the
    successor is searched field by field with carry, so no days, times or fires are listed
    and a rare calendar costs as little as a common one."""
    good = parsed_pairs(schedules, cron_col, tz_col).filter(F.col("__ok") & F.col("__tz_ok")) \
        .withColumn("__t0", F.unix_seconds(ts(now).cast("timestamp")) + 1)
    fires = good.select("__ce", "__tz", _first_fire().alias("__fire")).filter(F.col("__fire").isNotNull()) \
        .select("__ce", "__tz", F.timestamp_seconds("__fire").cast("timestamp_ntz").alias("next_fire_at"))
    return _per_schedule(schedules, fires, cron_col, tz_col).select(id_col, "next_fire_at")


def advance(schedules: DataFrame, now, queues: DataFrame | None = None, id_col: str = "schedule_id") -> DataFrame:
    """next_fire_at after ``now`` for every schedule. A run-once schedule keeps
    run_once_at until it has fired (``last_fired_at``), then goes inactive; a bad
    cron or zone, no fire until the last year, or a missing queue deactivates
    the schedule."""
    base = schedules.drop("next_fire_at")
    found = next_fire(base, now, id_col)
    out = base.join(found, id_col, "left")
    once = F.col("cron_expr").isNull() & F.col("run_once_at").isNotNull()
    # a run-once schedule stays due at run_once_at (even if that is already past)
    # until it has fired: last_fired_at at or after run_once_at
    fired = F.col("last_fired_at") if "last_fired_at" in out.columns else F.lit(None).cast("timestamp_ntz")
    once_next = F.when(fired.isNull() | (fired < F.col("run_once_at")), F.col("run_once_at"))
    next_at = F.when(once, once_next).otherwise(F.col("next_fire_at"))
    active = F.col("is_active") & next_at.isNotNull()
    if queues is not None:
        out = out.join(queues.select(F.col("queue_id"), F.lit(True).alias("__q")), "queue_id", "left")
        active = active & F.col("__q").isNotNull()
    out = out.withColumn("is_active", F.coalesce(active, F.lit(False)))
    return out.withColumn("next_fire_at", F.when(F.col("is_active"), next_at)).drop("__q")


# C4 ---------------------------------------------------------------------------
def fire(schedules: DataFrame, existing: DataFrame, queues: DataFrame, projects: DataFrame, now,
         id_col: str = "schedule_id"):
    """Fire every due schedule once per (schedule, fire_time): new recurring jobs
    (max_attempts = queue.max_receives or 3, exponential 5/3600, scheduled_for =
    fire time), their outbox rows,
    the new occurrence rows, and the schedules advanced past the fire time.
    Returns (jobs, outbox, occurrences, schedules)."""
    from .filters import due_condition
    from .transitions import outbox_for
    n = ts(now)
    due = schedules.filter(due_condition("cron", now))
    occ = due.select(id_col, F.col("next_fire_at").alias("fire_time"))
    merged, new_occ = insert_ignore(existing.select(id_col, "fire_time"), occ, [id_col, "fire_time"])
    src = new_occ.join(due.drop("next_fire_at"), id_col)
    q = queues.select("queue_id", "max_receives", "shard_count")
    jid = G.derived_id(F.lit("cron"), F.col(id_col), F.col("fire_time").cast("string"))
    jobs = src.join(q, "queue_id").select(
        jid.alias("job_id"), "queue_id", F.lit(0).cast("long").alias("shard_id"),
        F.lit("recurring").alias("kind"), F.lit("QUEUED").alias("status"), "payload", "priority",
        F.lit(0).cast("long").alias("attempt"),
        F.coalesce(F.col("max_receives").cast("long"), F.lit(3).cast("long")).alias("max_attempts"),
        F.lit("exponential").alias("retry_strategy"), F.lit(5).cast("long").alias("base_delay_secs"),
        F.lit(3600).cast("long").alias("max_delay_secs"), F.col(id_col).alias("scheduled_job_id"),
        "fire_time", F.col("fire_time").alias("scheduled_for"), n.alias("created_at"), n.alias("queued_at"),
        n.alias("updated_at"))
    outbox = outbox_for(jobs, queues, projects, now, "cron")
    new_occ = new_occ.join(jobs.select(F.col("scheduled_job_id").alias(id_col), "fire_time",
                                       F.col("job_id").alias("created_job_id")), [id_col, "fire_time"], "left")
    fired = due.select(id_col, F.col("next_fire_at").alias("__fired"))
    # advance past the fire just made; a missing queue deactivates
    adv = advance(due.withColumn("last_fired_at", F.col("next_fire_at")).drop("next_fire_at"), now, queues=queues)
    moved = (schedules.join(adv.select(id_col, F.col("next_fire_at").alias("__next"),
                                       F.col("is_active").alias("__act")), id_col, "left")
                      .join(fired, id_col, "left"))
    moved = moved.withColumns({
        "next_fire_at": F.when(F.col("__fired").isNotNull(), F.col("__next")).otherwise(F.col("next_fire_at")),
        "is_active": F.when(F.col("__fired").isNotNull(), F.col("__act")).otherwise(F.col("is_active")),
        "last_fired_at": F.when(F.col("__fired").isNotNull(), F.col("__fired")).otherwise(
            F.col("last_fired_at") if "last_fired_at" in schedules.columns
            else F.lit(None).cast("timestamp_ntz"))}).drop("__next", "__act", "__fired")
    return jobs, outbox, new_occ, moved
