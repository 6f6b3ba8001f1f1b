"""Operator 2: SimHash near-duplicates, linked through BK-trees.

A fingerprint has a bit set if it is set in over half of the 64-bit hashes of the text's shingles.
Fingerprints that differ in at most ``radius`` bits are linked; components follow the links.

Equal fingerprints are merged first (partial aggregation, so a group of copies of any size is one
row). The 64 bits are cut into stripes such that two fingerprints within the radius agree in a
chosen number of them; each combination of agreeing stripes is a shard key, so linked fingerprints
share a shard. In each shard a BK-tree (children keyed by the Hamming distance to the parent) is
built, and every fingerprint's search follows only edges within the radius. A shard larger than
``SHARD_ROWS`` is dealt into parts, and each pair of parts is a task of its own, so a task is bounded
however hot its key is. A task emits a spanning forest of its links, not the pairs. Shard trees
travel through the shuffle instead of a driver broadcast, as fingerprints of all documents must not
be collected there.

Null and empty texts, and texts without words, have fingerprint zero and are linked like others.
Rows with a null id take part; ``component_id`` is the smallest id reached, null if none has one.
Repeated rows give repeated results.
"""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from rewardlake.llm.common import F, run_arrow, text_of, written
from rewardlake.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 4096
# Wider shard keys are used as the number of distinct fingerprints grows, so that a shard of
# evenly spread fingerprints holds about this many.
ROWS_PER_KEY = 64
FRONTIER = 2_000_000        # tree positions visited at once (bounds memory)


def fingerprint(text: str, words_per: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()     # ASCII letters and blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - words_per + 1)
    stops = (ends[words_per - 1:] - 1).tolist() if len(words) >= words_per else [len(joined)]
    starts = [0, *ends[:n - 1].tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])     # big-endian
    votes = np.zeros(64, np.int64)
    view = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for s in range(0, len(view), 65_536):
        votes += np.unpackbits(view[s:s + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(view)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words_per) for t in b.column("text").to_pylist()],
                       dtype=np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))],
                                          ["doc_id", "fp"])

    return run_arrow(src, rows, f"doc_id {kind}, fp long")


def stripe_keys(n: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Masks of the shard keys for ``n`` fingerprints: with ``radius + a`` stripes, ``a`` of them
    agree between linked fingerprints. ``a`` is the smallest with enough key bits."""
    agree = 1
    while agree < 4 and n > ROWS_PER_KEY << (64 * agree // (radius + agree)):
        agree += 1
    stripes = radius + agree
    cuts = [64 * i // stripes for i in range(stripes + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    keys = [sum(masks[i] for i in c) for c in combinations(range(stripes), agree)]
    assert len(keys) == comb(stripes, agree)
    return keys


class Forest:
    """BK-trees of many shards side by side in flat arrays.

    Built level by level: every fingerprint not yet placed stands at a node and goes on to the
    child keyed by its distance from it; the first one there becomes the child."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        # equal fingerprints of a shard stand once in its tree
        n = len(fp)
        self.fp = fp
        child_parent, child_edge, child_node = [], [], []
        first = np.unique(shard, return_index=True)[1]
        self.root_of = {int(s): int(i) for s, i in zip(shard[first], first)}
        root = np.zeros(int(shard.max()) + 1 if n else 0, np.int64)
        root[shard[first]] = first
        at = root[shard]
        left = np.ones(n, bool)
        left[first] = False
        rows = np.flatnonzero(left)
        while len(rows):
            d = np.bitwise_count(fp[rows] ^ fp[at[rows]]).astype(np.int64)
            rows, d = rows[d > 0], d[d > 0]
            if not len(rows):
                break
            key = at[rows] * 65 + d
            keys, firsts, inverse = np.unique(key, return_index=True, return_inverse=True)
            nodes = rows[firsts]
            child_parent.append(keys // 65)
            child_edge.append(keys % 65)
            child_node.append(nodes)
            at[rows] = nodes[inverse]
            keep = np.ones(len(rows), bool)
            keep[firsts] = False
            rows = rows[keep]
        parent = np.concatenate(child_parent) if child_parent else np.zeros(0, np.int64)
        edge = np.concatenate(child_edge) if child_edge else np.zeros(0, np.int64)
        node = np.concatenate(child_node) if child_node else np.zeros(0, np.int64)
        order = np.lexsort((edge, parent))
        self.edge_key = (parent * 65 + edge)[order]     # sorted: one range per node and distances
        self.child = node[order]

    def matches(self, roots: np.ndarray, queries: np.ndarray, radius: int):
        """Yields arrays (query position, node) of the matches within ``radius``."""
        step = max(1, FRONTIER // 64)
        for s in range(0, len(queries), step):
            q = np.arange(s, min(len(queries), s + step))
            work = [(q, roots[q])]
            while work:
                q, node = work.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    work += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = np.bitwise_count(queries[q] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self.edge_key, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.edge_key, node * 65 + np.minimum(d + radius, 64),
                                     side="right")
                n = hi - lo
                total = int(n.sum())
                if total:
                    begin = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                    work.append((np.repeat(q, n), self.child[begin + np.arange(total)]))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]``; the smaller position is the root."""
    while len(a):
        for x in (a, b):
            while True:
                up = parent[x]
                if (up == x).all():
                    break
                x[:] = parent[up]
        differ = a != b
        a, b = a[differ], b[differ]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(shard: np.ndarray, fp: np.ndarray, is_query: np.ndarray, radius: int):
    """Spanning links (two arrays of fingerprints) within each shard; with queries in a shard,
    only theirs with its tree."""
    tree_rows = np.flatnonzero(~is_query)
    forest = Forest(shard[tree_rows], fp[tree_rows])
    asking = is_query.copy()
    has_query = np.zeros(int(shard.max()) + 1, bool)
    has_query[shard[is_query]] = True
    asking |= ~has_query[shard]
    asks = np.flatnonzero(asking)
    asks = asks[[int(s) in forest.root_of for s in shard[asks]]] if len(asks) else asks
    roots = np.array([forest.root_of[int(s)] for s in shard[asks]], dtype=np.int64)
    parent = np.arange(len(fp))
    for q, node in forest.matches(roots, fp[asks], radius):
        _union(parent, asks[q], tree_rows[node])
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    at = np.flatnonzero(fp != fp[parent])
    return fp[at], fp[parent[at]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links that join all distinct fingerprints (``fp``) within ``radius`` of each
    other, transitively."""
    n = distinct.count()
    spark = distinct.sparkSession
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    signed = [m - (1 << 64) if m >> 63 else m for m in stripe_keys(n, radius)]
    keyed = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "value"))
    keyed = keyed.select("fp", F.xxhash64("mask", "value").alias("key"))
    # Keys over the size of a task are dealt into parts; each pair of parts is one task.
    hot = (keyed.groupBy("key").count().where(F.col("count") > SHARD_ROWS)
           .select("key", F.ceil(F.col("count") / F.lit(SHARD_ROWS)).cast("int").alias("parts")))
    keyed = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    keyed = keyed.withColumn("part", part).withColumn("other", F.explode(
        F.sequence(F.lit(0), F.col("parts") - 1)))
    # tree of the smaller part number, queries of the larger
    tasks = keyed.select(
        "fp", (F.col("part") > F.col("other")).alias("is_query"),
        F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64(
            "key", F.least("part", "other"), F.greatest("part", "other"))).alias("task"))
    dealt = tasks.repartition("task").sortWithinPartitions("task")

    def run(it):
        held = None
        for b in it:
            held = b if held is None else pa.concat_batches([held, b])
            if held.num_rows < 4 * SHARD_ROWS:
                continue
            task = held.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1]))      # the last task may go on
            if cut:
                yield solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    def solved(b: pa.RecordBatch) -> pa.RecordBatch:
        shard = np.unique(b.column("task").to_numpy(), return_inverse=True)[1]
        u, v = shard_links(shard, b.column("fp").to_numpy().view(np.uint64),
                           np.asarray(b.column("is_query")), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                          ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` for every fingerprint of ``prints`` (``doc_id, fp``)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, words_per: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id, root`` per document; ``root`` names the component by
    its smallest fingerprint."""
    prints = written(fingerprints(docs, id_col, text_col, words_per))
    return prints.join(groups(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                radius: int = RADIUS, words_per: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id (rows with
    null ids last), and of rows that repeat it, one. All columns are kept."""
    fp, row = "__simhash_fp", "__simhash_row"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
        fps = np.array([fingerprint(t or "", words_per) for t in texts], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))],
                                          [*b.schema.names, fp])

    marked = written(run_arrow(docs, rows, f"{schema}, {fp} long")
                     .withColumn(row, F.monotonically_increasing_id()))
    prints = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"), row)
    kept = (prints.join(groups(prints, radius).select("fp", "root"), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("k"))
            .select(F.col(f"k.{row}").alias(row)))
    return marked.join(kept, row, "left_semi").select(*docs.columns)
