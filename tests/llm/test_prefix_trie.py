"""The prefix trie against one built turn by turn in dictionaries."""

import collections
import hashlib
import random
import zlib

import pytest

from jobsight.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, digest(role, text), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def brute(seqs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    out = collections.Counter()
    for p, cs in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha)] += 1
    return out


def same(df, want):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(tuple(r) for r in df.collect()) == want


def random_rows(seed, convs, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]),
                         rng.choice(["", None, "é", "漢字", "same text"][:words])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,convs,longest,shard", [(1, 60, 4, 5), (2, 40, 40, 7), (3, 25, 70, 1000), (4, 150, 3, 2)])
def test_random_tries(spark, seed, convs, longest, shard):
    rows = random_rows(seed, convs, longest)
    turns, sizes = T.rebuilt(T.turns_of(spark.createDataFrame(rows, SCHEMA)))
    same(T.trie(turns, sizes, shard), brute(sequences(rows)))


def test_long_copies_over_shards_and_blocks(spark):
    """Copies longer than several blocks, some going on, some ending at a block's last turn."""
    base = [("user", f"t{i}") for i in range(50)]
    rows = []
    for c in range(40):
        for i, (r, t) in enumerate(base[:(16, 32, 50, 33, 31)[c % 5]]):
            rows.append((c, i, r, t if not (c == 7 and i == 20) else "other"))
    df = spark.createDataFrame(rows, SCHEMA)
    turns = T.turns_of(df)
    sizes = turns.where("place = 0").select("conv_id", "n")
    for shard in (3, 100):
        same(T.trie(turns.drop("n"), sizes, shard), brute(sequences(rows, rebuild=False)))


def test_long_conversation_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 3)
    rows = [(c, None if c == 2 else i % 7, "user", f"t{i}") for c in (0, 1, 2, 5) for i in range(400)]
    same(T.op13(spark.createDataFrame(rows, SCHEMA)), brute(sequences(rows)))


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.op13(empty).collect() == []
    same(T.op13(spark.createDataFrame([(None, 1, "user", "no conversation")], SCHEMA)), collections.Counter())
    rows = [(3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, None, None), (4, 1, "", ""), (2**40, 0, "x", "w " * 300_000),
            (6, -1, "user", "a\x00b"), (-7 + 5 * 2, 9, "1", "2:x")]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS key", "'x' AS `a.b`", "3 AS block")
    same(T.op13(clash), brute(sequences(rows)))
    small = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id short, turn int, role string, text string")
    same(T.op13(small), brute(sequences([(1, 0, "u", "a"), (2, 0, "u", "a")])))


def test_turnless_only(spark):
    only = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:6]
    rows = [(c, 0, "user", "x") for c in only if c - c % 5 not in only]
    same(T.op13(spark.createDataFrame(rows, SCHEMA)), brute(sequences(rows)))


def test_whole_table(spark, small):
    from jobsight.llm.queries import op13_prefix_trie
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    same(op13_prefix_trie(spark, "/root/testdata/sf0.001"), brute(sequences(rows)))
