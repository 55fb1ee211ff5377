"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Strict patterns give the base spans, which are also the seeds. Loose shapes (an address
without a top-level domain, a number without country code or check digit, ...) give
candidates that are not personal data by themselves. The one or two words before an
identifier form a lexical pattern; a pattern's confidence is the share of all places where
those words occur, in any document, at which a known identifier of the kind follows. Candidates gain the noisy-or of the confidences of their
patterns; those above ``ACCEPT`` become known, sharpen the patterns and the next round
repeats this until nothing new is found. Only identifiers and contexts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3        # distinct known values that must follow a pattern
CONFIDENCE = 0.5   # least confidence of a pattern in use
ACCEPT = 0.6       # least score of a promoted candidate
ROUNDS = 1000      # never reached in practice: running out of rounds raises

# The strict patterns. Possessive loops and run starts give the same leftmost matches as
# the plain forms, in linear time and without deep recursion on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<!\S)[^\s@]++@[^\s@]++",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}(?!\w)",
    "card": r"(?<!\w)[0-9](?:[ .-]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?!\w)",
}
SMALL = 1 << 18    # patterns that are sent to every executor
SIGNS = "[0-9@]"   # no match of any pattern lacks both


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _small_parts(c: Column, seps: str) -> Column:
    def small(x: Column) -> Column:
        kept = F.regexp_replace(x, "^0+", "")
        return (F.length(kept) <= 3) & (F.coalesce(kept.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(c, seps), small)


def _luhn(c: Column) -> Column:
    turned = F.split(F.reverse(_digits(c)), "")
    def add(x: Column, i: Column) -> Column:
        d = x.try_cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(turned, add), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    return {"email": F.lit(True), "ip": _small_parts(c, r"\."),
            "card": F.when(n.between(13, 19), _luhn(c)).otherwise(False),
            "phone": n.between(9, 15)}[kind]


def _valid_loose(kind: str, c: Column) -> Column:
    return _small_parts(c, "[.:_-]") if kind == "ip" else F.lit(True)


def _located(df: DataFrame, out: str, text: str, pattern: str, valid) -> DataFrame:
    """Adds ``out``: an array of (start, end, value, l1, l2) of the pattern's matches in
    order; positions are code points. The text between matches gives both the positions
    and the words before a match."""
    m, p, s = f"{out}__m", f"{out}__p", f"{out}__s"
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) \
        .withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    none = F.array().cast("array<int>")

    def step(acc: Column, i: Column) -> Column:
        at = acc["pos"] + F.length(F.get(F.col(p), i))
        return F.struct((at + F.length(F.get(F.col(m), i))).alias("pos"),
                        F.concat(acc["out"], F.array(at)).alias("out"))

    df = df.withColumn(s, F.when(F.size(m) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("pos"), none.alias("out")),
        step, lambda acc: acc["out"])).otherwise(none))

    def row(x: Column, i: Column) -> Column:
        w = F.split(F.lower(F.trim(F.regexp_replace(F.get(F.col(p), i), r"\s+", " "))), " ")
        l1, l2 = F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(-2))
        at = F.get(F.col(s), i)
        return F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("value"),
                        F.when(l1 != "", l1).alias("l1"), F.when(l2 != "", F.concat_ws(" ", l2, l1)).alias("l2"))

    rows = F.transform(m, row)
    return df.withColumn(out, F.filter(rows, lambda r: valid(r["value"]))).drop(m, p, s)


def _identifiers(docs: DataFrame) -> DataFrame:
    """``doc_id, _th, base, loose`` for the rows that hold any sign; both arrays of
    (kind, start, end, value, l1, l2), ``loose`` without what overlaps a base span."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")) \
        .where(F.col("_text").rlike(SIGNS)).withColumn("_th", F.xxhash64("_text"))
    for k in KINDS:
        df = _located(df, f"b_{k}", "_text", BASE[k], lambda c, k=k: _valid(k, c))
        df = _located(df, f"l_{k}", "_text", LOOSE[k], lambda c, k=k: _valid_loose(k, c))
    df = df.drop("_text")

    def tagged(i: int, name: str) -> Column:
        return F.transform(name, lambda r: F.struct(
            F.lit(i).alias("kind"), *[r[f].alias(f) for f in ("start", "end", "value", "l1", "l2")]))

    def tag(a: str) -> Column:
        return F.concat(*[tagged(i, f"{a}_{k}") for i, k in enumerate(KINDS)])

    df = df.select("doc_id", "_th", tag("b").alias("base"), tag("l").alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.select("doc_id", "_th", "base", free.alias("loose"))


def _patterns(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.array("l1", "l2")).alias("pattern")).where(F.col("pattern").isNotNull())


def _discover(docs: DataFrame, ids: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, value`` of promoted candidates: a value counts where its own patterns carry it.
    Known values only ever grow, so the rounds end; running out of them raises instead of
    returning a part."""
    known = ids.select(F.explode("base").alias("r")).select("r.*")
    loose = ids.select(F.explode("loose").alias("r")).select("r.*")
    if loose.isEmpty() or known.isEmpty():
        return loose.select("kind", "value").limit(0)
    seen = cut(_patterns(known.withColumn("sure", F.lit(True)).unionByName(loose.withColumn("sure", F.lit(False))),
                         "kind", "value", "sure")
               .groupBy("kind", "value", "pattern").agg(F.max("sure").alias("sure"), F.count(F.lit(1)).alias("n")))
    # every place of the words in any document. A pattern that fewer than SUPPORT values
    # follow is never in use, so its places are not counted
    wanted = cut(seen.groupBy("kind", "pattern").agg(F.count_distinct("value").alias("values"))
                 .where(F.col("values") >= SUPPORT).select("pattern").distinct())
    w = F.split(F.lower(F.trim(F.regexp_replace(F.col("text").cast("string"), r"\s+", " "))), " ")
    words = docs.where(F.col("text").isNotNull()).select(w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(
        F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1),
        lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    every = words.select(F.explode(F.concat("w", pairs)).alias("pattern"))
    if wanted.count() <= SMALL:      # the same count either way; here only wanted words are shuffled
        places = every.join(F.broadcast(wanted), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))
    else:
        places = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("places")).join(wanted, "pattern", "left_semi")
    places = cut(places)
    got = seen.where("sure").select("kind", "value")
    sure = cut(got.distinct())
    for _ in range(rounds):
        marked = seen.join(sure.withColumn("known", F.lit(True)), ["kind", "value"], "left")
        conf = marked.where("known").groupBy("kind", "pattern") \
            .agg(F.sum("n").alias("hits"), F.count_distinct("value").alias("support")) \
            .where(F.col("support") >= SUPPORT).join(places, "pattern") \
            .withColumn("conf", F.least(F.lit(0.999), F.col("hits") / F.greatest("places", "hits"))) \
            .where(F.col("conf") >= CONFIDENCE).select("kind", "pattern", "conf")
        new = marked.where(F.col("known").isNull()).join(conf, ["kind", "pattern"]) \
            .groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")) \
            .where(F.col("score") >= ACCEPT).select("kind", "value")
        new = cut(new)
        if new.isEmpty():
            return loose.select("kind", "value").distinct().join(sure, ["kind", "value"], "left_semi")
        sure = cut(sure.union(new))
    raise RuntimeError(f"bootstrapping did not settle in {rounds} rounds")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, _th, base, found`` for the rows with digits or @: arrays of
    (kind, start, end), sorted; ``_th`` is the xxhash64 of the text (null: empty).

    A null text holds nothing; a null doc_id or repeated rows are answered each; ties do
    not arise, as spans are sorted by kind, start and end. Very long texts are read whole; an
    empty table gives an empty result."""
    ids = cut(_identifiers(docs))
    new = _discover(docs, ids, rounds)
    spans = lambda a: F.array_sort(F.transform(a, lambda r: F.struct(
        r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end"))))
    extra = ids.select("doc_id", "_th", F.explode("loose").alias("r")).select("doc_id", "_th", "r.*") \
        .join(new.select("kind", "value"), ["kind", "value"], "left_semi") \
        .groupBy("doc_id", "_th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    a, b = ids.alias("a"), extra.alias("b")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._th") == F.col("b._th")), "left") \
        .select("a.doc_id", "a._th", spans("base").alias("base"),
                F.array_sort(F.coalesce("more", none)).alias("found"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(
        ":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def op10(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    hits = find(docs)
    count = lambda i: F.size(F.filter("base", lambda r: r["kind"] == i)).cast("long")
    rich = hits.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                       _written(F.array_sort(F.concat("base", "found"))).alias("spans"))
    zero = F.lit(0).cast("long")
    plain = docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(SIGNS)) \
        .select("doc_id", *[zero.alias(f"n_{k}") for k in KINDS], F.sha2(F.lit(""), 256).alias("base_sha256"),
                F.lit("").alias("spans"))
    return rich.unionByName(plain)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the
    one that starts first stands for all of them."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"))))

    def step(acc: Column, r: Column) -> Column:
        fresh = r["start"] >= acc["pos"]
        gap = F.substring(text, acc["pos"] + 1, r["start"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], r["end"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], F.array(gap, F.get(names, r["kind"]))))
                        .otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<string>")
    return F.aggregate(order, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans of ``text`` masked; every row and column stays, and
    ``n_chars``, where there is one, follows the new text. Rows without digits or @ are
    passed on without a shuffle. Other columns may have any names."""
    return own_names(docs, ("doc_id", "text", "n_chars"), _mask)


def _mask(docs: DataFrame) -> DataFrame:
    cols = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = find(docs).where((F.size("base") > 0) | (F.size("found") > 0)) \
        .select(F.col("doc_id").alias("__pii_id"), F.col("_th").alias("__pii_th"),
                F.concat("base", "found").alias("__pii")).dropDuplicates(["__pii_id", "__pii_th"])
    rich = docs.where(text.rlike(SIGNS)).withColumn("__pii_key", F.xxhash64(text))
    clean = rich.join(hits, rich["doc_id"].eqNullSafe(hits["__pii_id"]) & (F.col("__pii_key") == F.col("__pii_th")), "left") \
        .withColumn("__pii_new", F.when(F.col("__pii").isNotNull(), masked(F.col("text"), F.col("__pii"))).otherwise(F.col("text")))
    n = lambda c: F.when(F.col("__pii").isNotNull(), F.length("__pii_new").cast(docs.schema[c].dataType))
    clean = clean.select(*[F.col("__pii_new").alias("text") if c == "text" else
                           F.coalesce(n(c), F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cols])
    return docs.where(~text.rlike(SIGNS)).unionByName(clean)
