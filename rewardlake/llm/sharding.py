"""Operator 8: shards by a k-d tree of weighted medians over document metadata.

A node holds a set of documents and a number of shards. It is cut along its widest metadata
dimension (range in the node over range in the table) so that each side's bytes are in proportion to
the shards it gets; a node with one shard is a leaf. All nodes of a level are cut together.

The cut is a weighted quantile found by counting: each pass sums bytes per (node, interval) for 256
intervals of the order key still in question, narrows to the interval that holds the quantile, and
stops when that interval weighs no more than ``TOLERANCE`` of a shard (``GROUP_TOLERANCE`` if it is
one group of equal texts) or holds one row. The order
within a node is (dimension, group, row): rows of equal dimension follow by the hash of their text,
so equal texts stay together unless their group is too heavy for it, and then by row number, so that
any hot value can be cut. A pass moves at most 24 * 256 sums to the driver.

Null texts have size 8 and null dimensions count as 0. Repeated rows are rows of their own. An empty
table gives an empty result. Other input columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window

from rewardlake.llm.common import F, n_groups, text_of, written

SHARDS = 24
OVERHEAD = 8                # bytes counted for a document besides its text
INTERVALS = 256
TOLERANCE = 0.0005          # share of a shard's target bytes
GROUP_TOLERANCE = 0.02     # the same for a group of equal texts, which is kept whole up to it
ROWS_PER_SLOT_GROUP = 100_000


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             dims: dict | None = None) -> DataFrame:
    """One narrow row per document: ``row``, id, size, crc, ``d0..``, group hash; written."""
    text = text_of(text_col)
    # functions of the text only, so that equal texts are one point
    chars = F.length(text)
    dims = dims or {"chars": chars, "words": F.size(F.split(text, " ")),
                    "bytes_per_char": F.when(chars > 0, F.octet_length(text) / chars)}
    return written(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"d{i}")
          for i, c in enumerate(dims.values())],
        F.xxhash64(text).cast("double").alias("grp")).withColumn(
            "row", F.monotonically_increasing_id().cast("double")))


def _pick(col, values: dict, default):
    """A literal per node number."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in sorted(values.items())
                                                  for x in (F.lit(k), F.lit(v))]), col),
                      F.lit(default))


def _keyed(df: DataFrame, dim_of: dict[int, int], n_dims: int) -> DataFrame:
    """``k0, k1, k2``: the order key of each row in its node."""
    dim = _pick(F.col("node"), dim_of, 0)
    k0 = F.col("d0")
    for i in range(1, n_dims):
        k0 = F.when(dim == i, F.col(f"d{i}")).otherwise(k0)
    return df.withColumns({"k0": k0, "k1": F.col("grp"), "k2": F.col("row")})


def weighted_cuts(df: DataFrame, want: dict[int, float], tol: float, group_tol: float) -> dict[int, tuple]:
    """For each node the key (k0, k1, k2) before which about ``want`` bytes lie.

    Rows with a smaller key go left; keys compare part by part."""
    parts = ("k0", "k1", "k2")
    level = {n: 0 for n in want}            # key part in question
    fixed = {n: [] for n in want}           # parts already equal to a value
    need = dict(want)                       # bytes still to go left of the cut
    span: dict[int, tuple[float, float]] = {}
    cuts: dict[int, tuple] = {}
    while len(cuts) < len(want):
        open_nodes = [n for n in want if n not in cuts]
        lvl = _pick(F.col("node"), {n: level[n] for n in open_nodes}, -1)
        key = F.when(lvl == 0, F.col("k0")).when(lvl == 1, F.col("k1")).otherwise(F.col("k2"))
        inside = lvl >= 0
        for p in range(2):                  # rows that share the fixed parts
            vals = {n: float(fixed[n][p]) for n in open_nodes if len(fixed[n]) > p}
            inside &= (lvl <= p) | (F.col(parts[p]) == _pick(F.col("node"), vals, 0.0))
        lo = _pick(F.col("node"), {n: float(span[n][0]) for n in open_nodes if n in span},
                   float("-inf"))
        hi = _pick(F.col("node"), {n: float(span[n][1]) for n in open_nodes if n in span},
                   float("inf"))
        # one cell for a node whose range is not known yet
        known = _pick(F.col("node"), {n: True for n in open_nodes if n in span}, False)
        cell = F.when(known, F.least(F.floor((key - lo) / (hi - lo) * INTERVALS),
                                     F.lit(INTERVALS - 1))).otherwise(F.lit(0)).cast("int")
        sums = (df.where(inside).where((key >= lo) & (key <= hi))
                .groupBy("node", cell.alias("cell"))
                .agg(F.sum("size").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"))
                .collect())                 # at most nodes * INTERVALS rows
        cells: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: (r["node"], r["cell"])):
            cells.setdefault(r["node"], []).append(r)
        for n in open_nodes:
            rows = cells.get(n, [])
            for i, r in enumerate(rows):
                if need[n] < r["w"] or i == len(rows) - 1:
                    break
                need[n] -= r["w"]
            if not rows:                    # no row is left to go: everything left of the cut
                cuts[n] = tuple(fixed[n]) + (float("inf"),) * (3 - len(fixed[n]))
            elif r["w"] <= tol or (r["lo"] == r["hi"] and (
                    level[n] == 2 or level[n] == 1 and r["w"] <= group_tol)):
                # the nearer end of the last interval
                if need[n] <= r["w"] / 2:
                    end = r["lo"]
                else:
                    end = rows[i + 1]["lo"] if i + 1 < len(rows) else math.nextafter(
                        r["hi"], math.inf)
                cuts[n] = (*fixed[n], end, *(-math.inf,) * (2 - len(fixed[n])))
            elif r["lo"] == r["hi"]:
                fixed[n].append(r["lo"])
                level[n] += 1
                span.pop(n, None)
            else:
                span[n] = (r["lo"], r["hi"])
    return cuts


def assign(meta: DataFrame, n_dims: int, shards: int = SHARDS) -> DataFrame:
    """``meta`` with ``node``, the leaf (shard) number of each row."""
    cur = meta.withColumn("node", F.lit(0))
    total = meta.agg(F.sum("size")).first()[0] or 0
    tol, group_tol = TOLERANCE * total / shards, GROUP_TOLERANCE * total / shards
    overall = meta.agg(*[F.max(f"d{i}").alias(f"x{i}") for i in range(n_dims)],
                       *[F.min(f"d{i}").alias(f"n{i}") for i in range(n_dims)]).first()
    widths = [max((overall[f"x{i}"] or 0) - (overall[f"n{i}"] or 0), 1e-300)
              for i in range(n_dims)]
    holds = {0: shards}                     # node -> shards below it; a node is its first shard
    while any(s > 1 for s in holds.values()):
        stats = {r["node"]: r for r in cur.groupBy("node").agg(
            F.sum("size").alias("w"), *[F.max(f"d{i}").alias(f"x{i}") for i in range(n_dims)],
            *[F.min(f"d{i}").alias(f"n{i}") for i in range(n_dims)]).collect()}
        split = {n: s for n, s in holds.items() if s > 1 and n in stats}
        dim_of = {n: max(range(n_dims), key=lambda i, n=n: (
            stats[n][f"x{i}"] - stats[n][f"n{i}"]) / widths[i]) for n in split}
        left = {n: s // 2 for n, s in split.items()}
        keyed = _keyed(cur, dim_of, n_dims)
        cuts = weighted_cuts(keyed, {n: stats[n]["w"] * left[n] / s for n, s in split.items()},
                             tol, group_tol)
        node = F.col("node")
        c = [_pick(node, {n: float(k[p]) for n, k in cuts.items()}, float("inf"))
             for p in range(3)]
        right = (F.col("k0") > c[0]) | ((F.col("k0") == c[0]) & (
            (F.col("k1") > c[1]) | ((F.col("k1") == c[1]) & (F.col("k2") >= c[2]))))
        # rows of leaves and of nodes not split stay
        moved = F.when(right & _pick(node, {n: True for n in split}, False),
                       node + _pick(node, left, 0)).otherwise(node)
        cur = written(keyed.withColumn("node", moved).select(*meta.columns, "node"))
        holds = {m: s for n, all_ in holds.items() for m, s in (
            ((n, all_ // 2), (n + all_ // 2, all_ - all_ // 2)) if n in split
            else ((n, 1 if all_ > 1 else all_),))}
    return cur


def with_slots(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``slot``: row number in the shard, gapless from 0. Rows are numbered within small groups of a
    shard; the groups' counts give their first numbers."""
    per = n_groups(df.count(), shards * ROWS_PER_SLOT_GROUP)
    df = df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(per * 8)).cast("int"))
    sizes = df.groupBy("shard", "part").count()          # shards * parts rows
    first = sizes.withColumn("first", F.sum("count").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    numbered = df.withColumn("at", F.row_number().over(
        Window.partitionBy("shard", "part").orderBy("row")) - 1)
    return numbered.join(first, ["shard", "part"]).withColumn(
        "slot", (F.col("first") + F.col("at")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                    text_col: str = "text", dims: dict | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: a shard of nearly equal bytes for every row."""
    meta = metadata(docs, id_col, text_col, dims)
    n_dims = sum(c[0] == "d" and c[1:].isdigit() for c in meta.columns)
    placed = assign(meta, n_dims, shards).withColumn("shard", F.col("node"))
    return with_slots(placed, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as Parquet folders ``shard=N``; ids must be unique. A shard's rows are dealt
    over several files."""
    full = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    full.repartition("shard", F.pmod("slot", F.lit(16))).write.partitionBy("shard").parquet(path)
