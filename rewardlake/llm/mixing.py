"""Operator 11: mixing sources to target weights by pivotal dependent rounding, in DataFrame
functions only.

Sources share ``factor`` times all words by their weights; a target stops at ``most`` times its
source's words and the excess is reshared by weight (water-filling: Newton steps on the common rate,
each one aggregate over the source table). A document of a source takes part with ``target /
source words`` copies; the whole part is given to all, and the fractions are rounded so that their
word mass is kept: documents of a source are paired, mass in words moves at random from one to the
other, in expectation none, until one of the two has a whole number of copies; the other goes on to
the next pair. This runs in buckets of about ``PER_BUCKET`` documents, largest first, and the one
fraction that a bucket leaves goes to the buckets of the next level: a reduction tree whose levels
grow with the logarithm of a source's documents. The last fraction of a source is rounded by a draw of
its own. Large documents come first, by tiers of size: what the last fraction of a tier took
too much or too little is moved to the next tier's fractions, all of a source alike, so the words taken
differ from the target by less than the words of one short document, if the source has some. Where
the documents left could not make up for one end of the draw, the other end is taken.

A hot source is only many buckets. Rows that agree in id, source and text are one group: of ``n`` rows
with fraction ``f``, ``floor(n f)`` get a copy at once and the group goes on with the rest.
Draws are hashes of row contents, seed and level, so reruns agree on any number of partitions.

Null texts have no words; documents without words take part with their whole copies and no words. Null
sources are one source, last in order; null ids stay null. An empty table gives an empty result. Other
input columns are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame

from rewardlake.llm.common import F, n_groups, text_of, written
from rewardlake.operators.joins import bounded_broadcast
from rewardlake.operators.positions import numbered

WEIGHTS = (5, 2, 1)         # of the sources in order, repeating
FACTOR = 1.5
MOST = 2
PER_BUCKET = 128
# Tiers of documents: more words than so many times the mean of their source; the last has the rest.
TIERS = (1.0, 0.25, 0.0)
ROWS_AT_ONCE = 10_000       # repeated rows written out from one group at a time
# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def _draw(level: int, seed: int) -> Column:
    """Uniform in [0, 1) from a row's content."""
    h = F.xxhash64(F.lit(seed), F.lit(level), "source_no", "doc_id", "text_hash", "size")
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """``doc_id, source, no_source, size, text_hash, n``: one row per group of equal rows; written."""
    source = F.col(source_col).cast("string")
    return written(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"),
        source.isNull().alias("no_source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_of(text_col)).alias("text_hash"))
        .groupBy("doc_id", "source", "no_source", "size", "text_hash")
        .agg(F.count(F.lit(1)).alias("n")))


def source_table(rows: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, no_source, source_size, n_docs, source_no, weight`` in code-point order, null
    last; written."""
    totals = written(rows.groupBy("source", "no_source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")))
    at = numbered(totals, [F.col("no_source").asc(), F.col("source").asc()], "source_no")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return written(at.withColumn("weight", F.element_at(
        cycle, (F.col("source_no") % len(weights) + 1).cast("int"))))


def with_targets(sources: DataFrame, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """``sources`` with ``target``: weighted shares of ``factor`` times all words, none above
    ``most`` times its source's words."""
    cap = F.col("source_size") * float(most)
    total = float(factor) * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate, held = 0.0, -1
    while True:
        full = cap <= F.lit(rate) * F.col("weight")
        r = sources.agg(F.sum(F.when(full, F.col("source_size"))).alias("size"),
                        F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                        F.sum(full.cast("long")).alias("n")).first()
        # once no further source is full, the rate is the one its targets were set by
        if r["n"] == held or not r["weight"]:
            break
        held = r["n"]
        rate = max(0.0, total - float(most) * (r["size"] or 0)) / r["weight"]
    full = cap <= F.lit(rate) * F.col("weight")
    return sources.withColumn("target", F.when(full | F.lit(not r["weight"]), cap).otherwise(
        F.lit(rate) * F.col("weight")))


_ITEM = "struct<size:bigint,text_hash:bigint,doc_id:{kind},n:bigint,whole:bigint,p:double,u:double>"
_DONE = "struct<doc_id:{kind},size:bigint,text_hash:bigint,n:bigint,whole:bigint,up:boolean>"


def _pivot(items: Column, kind: str) -> Column:
    """Pairs the running fraction with each item in turn: ``done`` are the items with whole copies,
    ``rest`` the fraction that is left."""
    item, done = _ITEM.format(kind=kind), _DONE.format(kind=kind)

    def finished(x: Column, up: Column) -> Column:
        return F.struct(x["doc_id"], x["size"], x["text_hash"], x["n"], x["whole"], up).cast(done)

    def left(x: Column, mass: Column) -> Column:
        p = F.least(F.greatest(mass / x["size"], F.lit(0.0)), F.lit(1.0))
        return F.struct(x["size"], x["text_hash"], x["doc_id"], x["n"], x["whole"], p,
                        x["u"]).cast(item)

    def step(acc: Column, x: Column) -> Column:
        i = acc["rest"]
        mass_i, mass_x = i["p"] * i["size"], x["p"] * x["size"]
        room_i, room_x = i["size"] - mass_i, x["size"] - mass_x
        gain_i, gain_x = F.least(room_i, mass_x), F.least(mass_i, room_x)
        # each direction with the chance that leaves both expectations as they are
        i_gains = x["u"] * (gain_i + gain_x) < gain_x
        i_done = F.when(i_gains, room_i <= mass_x).otherwise(mass_i <= room_x)
        rest = (F.when(i_done, left(x, F.when(i_gains, mass_x - room_i).otherwise(mass_x + mass_i)))
                .otherwise(left(i, F.when(i_gains, mass_i + mass_x).otherwise(mass_i - room_x))))
        one = F.when(i_done, finished(i, i_gains)).otherwise(finished(x, ~i_gains))
        return F.when(i.isNull(), F.struct(x.cast(item).alias("rest"), acc["done"].alias("done"))
                      ).otherwise(F.struct(rest.alias("rest"), F.concat(
                          acc["done"], F.array(one)).alias("done")))

    start = F.struct(F.lit(None).cast(item).alias("rest"),
                     F.array().cast(f"array<{done}>").alias("done"))
    return F.aggregate(items, start, step)


def rounded(parts: DataFrame, seed: int, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``parts`` (groups with ``whole`` sure copies above the common ones and a fraction ``p``, of
    sources with ``n_rows`` groups) with ``up``: whether the group gets one copy more. ``more`` and
    ``less`` are the words that later tiers can still take more or less."""
    kind = parts.schema["doc_id"].dataType.simpleString()
    of_source = ["source_no", "source_size", "target", "common", "more", "less"]
    sure = parts.where((F.col("p") <= 0) | (F.col("size") <= 0))
    columns = [*of_source[:4], "doc_id", "size", "text_hash", "n", "whole", "up"]
    out = [sure.withColumn("up", F.lit(False)).select(*columns)]
    cur = parts.where((F.col("p") > 0) & (F.col("size") > 0)).withColumn(
        "buckets", F.ceil(F.col("n_rows") / per_bucket))
    cells = n_groups(parts.agg(F.max("n_rows")).first()[0] or 0, per_bucket)
    level = 0
    while True:
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(~level), "doc_id", "text_hash", "size"),
                       F.col("buckets"))
        keyed = cur.withColumns({"bucket": place, "u": _draw(level, seed)})
        item = F.struct((-F.col("size")).alias("first"), "text_hash", "doc_id", "size", "n",
                        "whole", "p", "u")
        items = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(
            x["size"], x["text_hash"], x["doc_id"], x["n"], x["whole"], x["p"], x["u"])
            .cast(_ITEM.format(kind=kind)))
        tree = written(keyed.groupBy(*of_source, "buckets", "bucket").agg(
            items.alias("items")).select(*of_source, "buckets", _pivot(F.col("items"), kind)
                                         .alias("r")).select(*of_source, "buckets", "r.*"))
        out.append(tree.select(*of_source, F.explode("done").alias("d")).select(
            *of_source, "d.*").select(*columns))
        cur = tree.where(F.col("rest").isNotNull()).select(*of_source, "buckets", "rest.*")
        level += 1
        if cells == 1:
            break
        cells = n_groups(cells, per_bucket)
        cur = cur.withColumn("buckets", F.ceil(F.col("buckets") / per_bucket))
    # by a draw where later documents can make up for either end, else so that they can, or nearer
    mass = F.col("p") * F.col("size")
    can_go, can_stay = F.col("size") - mass <= F.col("less"), mass <= F.col("more")
    up = (F.when(can_go & can_stay, _draw(level, seed) < F.col("p"))
          .when(can_go | can_stay, can_go).otherwise(F.col("p") >= 0.5))
    out.append(cur.withColumn("up", up).select(*columns))
    return reduce(DataFrame.unionByName, out)


def by_tiers(parts: DataFrame, seed: int, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``parts`` (groups of sources with ``common`` copies for all and a ``fraction``) rounded tier
    by tier, the largest documents first. What the rounding of a tier takes too much or too little
    moves the fractions of the next tier's documents, all of a source alike: the next tier is
    one partner for the last fraction of the tier before."""
    words = F.col("size") * F.col("n")
    state = parts.groupBy("source_no", "fraction").agg(
        *[F.sum(F.when(F.col("tier") == k, words).otherwise(0)).alias(f"words_{k}")
          for k in range(len(TIERS))],
        *[F.sum((F.col("tier") == k).cast("long")).alias(f"rows_{k}") for k in range(len(TIERS))])
    state = written(state.withColumn("owed", F.lit(0.0)))
    out = []
    for k in range(len(TIERS)):
        moved = F.when(F.col(f"words_{k}") > 0, F.col("owed") / F.col(f"words_{k}")).otherwise(0.0)
        later = sum((F.col(f"words_{j}") for j in range(k + 1, len(TIERS))), F.lit(0.0))
        now = state.select(
            "source_no", F.col(f"rows_{k}").alias("n_rows"),
            F.least(F.greatest(F.col("fraction") + moved, F.lit(0.0)), F.lit(1.0)).alias("now"),
            (later * (1 - F.col("fraction"))).alias("more"),
            (later * F.col("fraction")).alias("less"))
        copies = F.col("n") * F.col("now")
        done = rounded(parts.where(F.col("tier") == k).drop("n_rows", "fraction").join(
            bounded_broadcast(now), "source_no").withColumns({
                "whole": F.floor(copies).cast("long"), "p": copies - F.floor(copies)}),
            seed + k, per_bucket)
        out.append(done)
        if k + 1 < len(TIERS):
            got = done.groupBy("source_no").agg(F.sum(
                F.col("size") * (F.col("whole") + F.col("up").cast("long"))).alias("got"))
            owed = (F.col("owed") + F.col("fraction") * F.col(f"words_{k}")
                    - F.coalesce("got", F.lit(0)))
            state = written(state.join(got, "source_no", "left").withColumn("owed", owed)
                            .drop("got"))
    return reduce(DataFrame.unionByName, out)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, factor: float = FACTOR, most: int = MOST,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 11, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row: how often the mix takes
    the document, and the words that makes."""
    rows = sized(docs, id_col, text_col, source_col)
    sources = with_targets(source_table(rows, weights), factor, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = written(sources.withColumn("common", F.floor(rate).cast("long")).withColumn(
        "fraction", rate - F.col("common")))
    mean = F.col("source_size") / F.col("n_docs")
    tier = reduce(lambda t, k: F.when(F.col("size") > TIERS[k] * mean, k).otherwise(t),
                  range(len(TIERS) - 2, -1, -1), F.lit(len(TIERS) - 1))
    parts = written(rows.join(bounded_broadcast(sources), ["source", "no_source"])
                    .withColumn("tier", tier).drop("source", "no_source", "n_docs", "weight"))
    return taken(by_tiers(parts, seed, per_bucket))


def taken(groups: DataFrame) -> DataFrame:
    """One row per document from the rounded groups."""
    more = F.col("whole") + F.col("up").cast("long")
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {ROWS_AT_ONCE}")))
    each = F.explode(F.sequence(F.col("chunk") * ROWS_AT_ONCE + 1,
                                F.least("n", (F.col("chunk") + 1) * ROWS_AT_ONCE)))
    rows = groups.withColumn("more", more).withColumn("chunk", chunk).withColumn("at", each)
    copies = F.col("common") + (F.col("at") <= F.col("more")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))
