"""Creation in request order against a model that takes requests one by one."""

import random

import pytest

from jobsight.operators import transitions as B

NOW = "2024-01-01 00:00:00"
ITEM = "struct<payload:string,priority:bigint,idempotency_key:string>"


@pytest.fixture(scope="module")
def ctx(spark):
    def make(limits):
        q = spark.createDataFrame([(i, 1, 5, 1, lim, 60) for i, lim in limits.items()],
                                  "queue_id long, project_id long, default_priority long, shard_count long, "
                                  "rate_limit long, rate_window_secs long")
        return q, spark.createDataFrame([(1, 1)], "project_id long, org_id long")
    return make


def model(batches, limits, held):
    """``batches`` of (id, queue, [(priority, key)]) in order: {id: reason or None}."""
    made, keys, out = dict.fromkeys(limits, 0), {q: {k for p, k in held if p == q} for q in limits}, {}
    for b, q, items in batches:
        ks = [k for _, k in items if k is not None]
        if any(p is not None and not 0 <= p <= 100 for p, _ in items):
            out[b] = "priority_out_of_range"
        elif limits[q] is not None and made[q] + len(items) > limits[q]:
            out[b] = "rate_limited"
        elif len(set(ks)) < len(ks) or keys[q] & set(ks):
            out[b] = "idempotency_conflict"
        else:
            out[b], made[q] = None, made[q] + len(items)
            keys[q] |= set(ks)
    return out


def test_a_conflict_leaves_room(spark, ctx):
    q, p = ctx({1: 2})
    reqs = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 1, "a")], "request_id long, queue_id long, body_key string")
    jobs, _, rej = B.create_jobs(reqs, q, p, NOW, rate_limits=True)
    assert sorted(r.request_id for r in jobs.collect()) == [1, 3]
    assert sorted((r.request_id, r.reason) for r in rej.collect()) == [(2, "idempotency_conflict"), (4, "rate_limited")]


def test_a_rejected_batch_frees_its_keys(spark, ctx):
    q, p = ctx({1: None})
    rows = [(1, 1, [("{}", None, "k1"), ("{}", None, "k1")]), (2, 1, [("{}", None, "k1")]), (10, 1, [("{}", None, "k1")]),
            (3, 1, [("{}", 500, "k2")]), (4, 1, [("{}", 1, "k2")])]
    reqs = spark.createDataFrame(rows, f"batch_request_id long, queue_id long, items array<{ITEM}>")
    batches, jobs, outbox, rej = B.create_batches(reqs, q, p, NOW)
    assert sorted((r.batch_request_id, r.reason) for r in rej.collect()) == [
        (1, "idempotency_conflict"), (3, "priority_out_of_range"), (10, "idempotency_conflict")]
    assert batches.count() == 2 and jobs.count() == 2 and outbox.count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, ctx, seed):
    rng = random.Random(seed)
    limits = {1: 30, 2: None, 3: 0, 4: 7}
    held = [(1, "h"), (2, "k3")]
    batches = [(i, rng.choice(list(limits)), [(rng.choice([None, 1, 50, 101 if rng.random() < .1 else 2]),
                                                rng.choice([None, "h", f"k{rng.randrange(40)}"])) for _ in range(rng.randint(1, 5))])
               for i in range(160)]
    q, p = ctx(limits)
    reqs = spark.createDataFrame([(b, qq, [("{}", pr, k) for pr, k in its]) for b, qq, its in batches],
                                 f"batch_request_id long, queue_id long, items array<{ITEM}>")
    existing = spark.createDataFrame(held, "queue_id long, idempotency_key string")
    made, jobs, _, rej = B.create_batches(reqs, q, p, NOW, existing=existing, rate_limits=True)
    want = model(batches, limits, held)
    assert {r.batch_request_id: r.reason for r in rej.collect()} == {b: r for b, r in want.items() if r}
    assert made.count() == sum(r is None for r in want.values())
    assert jobs.count() == sum(len(its) for b, _, its in batches if want[b] is None)


def test_a_long_chain_of_batches(spark, ctx):
    """Batch i shares a key with batch i + 1, so every other one is accepted."""
    q, p = ctx({1: None})
    reqs = spark.createDataFrame([(i, 1, [("{}", None, f"k{i}"), ("{}", None, f"k{i + 1}")]) for i in range(12)],
                                 f"batch_request_id long, queue_id long, items array<{ITEM}>")
    rej = B.create_batches(reqs, q, p, NOW)[3]
    assert sorted(r.batch_request_id for r in rej.collect()) == [1, 3, 5, 7, 9, 11]


def test_text_ids_keep_their_order(spark, ctx):
    q, p = ctx({1: 2})
    rows = [("b-2", 1, "x"), ("10", 1, "x"), ("9", 1, None), ("b-1", 1, None), ("a", 1, "y")]
    reqs = spark.createDataFrame(rows, "request_id string, queue_id long, body_key string")
    jobs, _, rej = B.create_jobs(reqs, q, p, NOW, rate_limits=True)
    assert sorted(r.request_id for r in jobs.collect()) == ["10", "9"] and rej.filter("reason = 'rate_limited'").count() == 3
