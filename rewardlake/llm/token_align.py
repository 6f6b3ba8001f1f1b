"""Operator 13: alignment of two tokenizers' tokens by lockstep vectorised merging.

Every text is encoded by A (a byte-level BPE vocabulary file; space and text) and by B (a piece
model, which adds the space itself). Both token sequences spell the same bytes; two tokens are
linked if their byte ranges overlap, and a byte offset where a token of both ends cuts them into
groups. The merge runs over all documents of a batch at once: one state vector holds a pair of
token positions for each document still being merged; a step emits the link of every pair, the cuts
where both tokens end together, advances A, B or both, and drops what is finished. So that one long
document does not keep a nearly empty vector going, a document enters as several lanes of at most
``LANE_BYTES``; a link belongs to the lane in which its overlap begins.

Corpus statistics: a block (the texts of one task up to ``BLOCK_CHARS`` characters) lists its
distinct id pairs once; these are summed over the corpus, the sums go back to the blocks that
hold the pair, and each block adds up the sums of its documents. So a frequent pair is sent once for
each block and not for each link, and no table of all pairs is held in one place.

Null and empty texts, and texts whose tokens do not spell space and text, have no tokens. Texts of
any length are aligned whole. Repeated rows are aligned each; null ids stay null; an empty table
gives an empty result; other input columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window

from rewardlake.llm.bpe import SPLIT, byte_alphabet
from rewardlake.llm.common import F, prepared, text_of, written

LANE_BYTES = 512
# Characters aligned at once and in a block of the statistics (bound memory, not results).
CHARS_AT_ONCE = 2_000_000
BLOCK_CHARS = 12_000_000
# A longer run of white space goes to the slower library: the fast one recurses on such runs.
LONG_SPACE = re.compile(r"\s{2000}")
FAST_SPLIT = SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")


class ByteVocabulary:
    """A: ids of whole texts by a byte-level BPE vocabulary file; special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        added = {a["content"] for a in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        raw = {i: bytes(back[c] for c in t) for t, i in vocab.items()
               if t not in added and all(c in back for c in t)}
        self.table = [raw.get(i, b"") for i in range(max(vocab.values()) + 1)]
        self.fast = None
        if self._in_merge_order(spec, vocab):
            import tiktoken
            self.fast = tiktoken.Encoding(
                "plain", pat_str=FAST_SPLIT, special_tokens={},
                mergeable_ranks={b: i for i, b in raw.items() if b})

    @staticmethod
    def _in_merge_order(spec: dict, vocab: dict[str, int]) -> bool:
        """Whether ids rise with the rank of the merge that makes them, as the fast library needs,
        and nothing but the split pattern comes before the merges."""
        if spec.get("normalizer") or spec["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                "use_regex": True}:
            return False
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))]
                for m in spec["model"]["merges"]]
        return all(a < b for a, b in zip(made, made[1:])) and made[0] >= 256

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LONG_SPACE.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceModel:
    """B: ids of whole texts by a piece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                      else p.replace("▁", " ").encode("utf-8")
                      for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Pair:
    """Both vocabularies with the lengths of their tokens and the words of the group texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteVocabulary(a_path), PieceModel(b_path)
        self.len_a = np.array([len(t) for t in self.a.table], np.int64)
        self.len_b = np.array([len(t) for t in self.b.table], np.int64)
        # an id followed by a comma, or by the mark after the last one of its side
        na, nb = len(self.a.table), len(self.b.table)
        self.words = ([f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)]
                      + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)])

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, or none if they do not spell space and text."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text), self.b.encode(text)
        want = (" " + text).encode("utf-8")
        if (b"".join(map(self.a.table.__getitem__, a)) != want
                or b"".join(map(self.b.table.__getitem__, b)) != want):
            return [], []
        return a, b


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Pair(a_path, b_path)
    return _LOADED[a_path, b_path]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, docs: np.ndarray,
             lane_bytes: int = LANE_BYTES) -> tuple[np.ndarray, ...]:
    """Links ``(i, j)`` and cuts ``(i, j)`` of all documents, in order.

    ``end_a`` and ``end_b`` are the byte offsets at which the tokens of all documents, laid end
    to end, end; ``docs`` holds the offsets at which documents begin, and the total."""
    begin, stop = docs[:-1], docs[1:]
    lanes = -(-(stop - begin) // lane_bytes)
    lo = np.repeat(begin, lanes) + lane_bytes * (
        np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    hi = np.minimum(lo + lane_bytes, np.repeat(stop, lanes))
    i, j = (np.searchsorted(e, lo, side="right") for e in (end_a, end_b))
    # a link that began in the lane before is that lane's
    begins = np.maximum(np.where(i > 0, end_a[i - 1], 0), np.where(j > 0, end_b[j - 1], 0))
    m = np.minimum(end_a[i], end_b[j])
    late = begins < lo
    i, j = i + (late & (end_a[i] == m)), j + (late & (end_b[j] == m))
    on = ~late | (m < hi)
    i, j, hi = i[on], j[on], hi[on]
    links_i, links_j, cuts_i, cuts_j = [], [], [], []
    while len(i):
        links_i.append(i)
        links_j.append(j)
        a, b = end_a[i], end_b[j]
        m = np.minimum(a, b)
        a_ends, b_ends = a == m, b == m
        cut = a_ends & b_ends
        cuts_i.append(i[cut])
        cuts_j.append(j[cut])
        i, j = i + a_ends, j + b_ends
        on = m < hi
        if not on.all():
            i, j, hi = i[on], j[on], hi[on]
    none = [np.zeros(0, np.int64)]
    li, lj, ci, cj = (np.concatenate(x or none) for x in (links_i, links_j, cuts_i, cuts_j))
    by = np.argsort(li + lj, kind="stable")          # rises along the merge
    li, lj = li[by], lj[by]
    ci.sort()
    cj.sort()
    return li, lj, ci, cj


class Aligned:
    """The tokens, links and cuts of some texts; positions run over all of them."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        both = [pair.tokens(t) for t in texts]
        self.pair, n = pair, len(texts)
        self.n_a = np.array([len(a) for a, _ in both], np.int64)
        self.n_b = np.array([len(b) for _, b in both], np.int64)
        self.a = np.fromiter((x for a, _ in both for x in a), np.int64, self.n_a.sum())
        self.b = np.fromiter((x for _, b in both for x in b), np.int64, self.n_b.sum())
        self.first_a = np.concatenate([[0], np.cumsum(self.n_a)])
        self.first_b = np.concatenate([[0], np.cumsum(self.n_b)])
        end_a, end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        docs = np.concatenate([[0], end_a])[self.first_a]
        self.li, self.lj, self.ci, self.cj = lockstep(end_a, end_b, docs)
        doc_of = np.repeat(np.arange(n), self.n_a)
        self.link_doc = doc_of[self.li]
        self.n_links = np.bincount(self.link_doc, minlength=n)
        self.n_groups = np.bincount(doc_of[self.ci], minlength=n)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        na, nb = len(self.pair.a.table), len(self.pair.b.table)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.ci], last_b[self.cj] = True, True
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        ends_a = np.concatenate([[0], self.ci + 1])
        ends_b = np.concatenate([[0], self.cj + 1])
        words = np.empty(len(self.a) + len(self.b), np.int64)
        # all of A's tokens of a group, then all of B's
        words[np.arange(len(self.a)) + ends_b[group_a]] = self.a + na * last_a
        words[np.arange(len(self.b)) + ends_a[group_b + 1]] = 2 * na + self.b + nb * last_b
        at = self.first_a + self.first_b
        pick = self.pair.words.__getitem__
        return ["".join(map(pick, words[s:e].tolist()))[:-1] for s, e in zip(at, at[1:])]

    def pairs(self) -> np.ndarray:
        """The id pair of every link as one number."""
        return self.a[self.li] << 32 | self.b[self.lj]


def _portions(texts: list, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``chars`` characters, or of one text."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to] or "") <= chars):
            n += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, links, cuts``: the tokens of every whole text, the positions of
    linked tokens, and the positions of the last tokens of each group, all from 0 in the text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    prepared(docs.sparkSession)
    two = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def lists(values, counts):
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), values)

    def structs(a, b):
        return pa.StructArray.from_arrays([pa.array(a.astype(np.int32)),
                                           pa.array(b.astype(np.int32))], fields=list(two))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(a_path, b_path)
        for batch in it:
            texts = batch.column("text").to_pylist()
            for s, e in _portions(texts, CHARS_AT_ONCE):
                al = Aligned(pair, texts[s:e])
                base_a, base_b = al.first_a[:-1], al.first_b[:-1]
                cut_doc = np.repeat(np.arange(e - s), al.n_groups)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s, e - s),
                     lists(pa.array(al.a.astype(np.int32)), al.n_a),
                     lists(pa.array(al.b.astype(np.int32)), al.n_b),
                     lists(structs(al.li - base_a[al.link_doc], al.lj - base_b[al.link_doc]),
                           al.n_links),
                     lists(structs(al.ci - base_a[cut_doc], al.cj - base_b[cut_doc]),
                           al.n_groups)],
                    ["doc_id", "a_ids", "b_ids", "links", "cuts"])

    return src.mapInArrow(batches, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, "
                          "links array<struct<a:int,b:int>>, cuts array<struct<a:int,b:int>>")


_BLOCK_ROWS = ("part int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
               "groups_sha256 string, codes array<int>, times array<int>, pairs array<long>, "
               "links array<long>")
_RESULT = ("doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")


class _Block:
    """Documents that share one list of id pairs."""

    def __init__(self):
        self.chars, self.columns, self.found = 0, [[] for _ in range(6)], []

    def add(self, ids: list, al: Aligned, texts: list) -> None:
        self.chars += sum(len(t or "") for t in texts)
        digests = [hashlib.sha256(g.encode()).hexdigest() if n else ""
                   for g, n in zip(al.group_texts(), al.n_a.tolist())]
        for col, new in zip(self.columns, (ids, al.n_a, al.n_b, al.n_groups, al.n_links,
                                           digests)):
            col.extend(new if isinstance(new, list) else new.tolist())
        pairs, code = np.unique(al.pairs(), return_inverse=True)
        width = max(1, len(pairs))
        cells, times = np.unique(al.link_doc * width + code, return_counts=True)
        self.found.append((len(ids), pairs, cells // width, cells % width, times))

    def rows(self, part: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The documents, each with its distinct pairs as places in the block's list and how many
        links hold them; then a row with that list and its sums."""
        all_pairs = np.unique(np.concatenate([p for _, p, *_ in self.found]))
        sums = np.zeros(len(all_pairs), np.int64)
        codes, times, sizes = [], [], []
        for n, pairs, doc, code, t in self.found:
            code = np.searchsorted(all_pairs, pairs)[code]
            np.add.at(sums, code, t)
            codes.append(code)
            times.append(t)
            sizes.append(np.bincount(doc, minlength=n))
        n = len(self.columns[0])
        at = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))

        def lists(parts):
            return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts).astype(np.int32)))

        types = [kind] + [pa.int64()] * 4 + [pa.string()]
        names = ["part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes",
                 "times", "pairs", "links"]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()),
             *[pa.array(c, t) for c, t in zip(self.columns, types)], lists(codes), lists(times),
             pa.nulls(n, longs), pa.nulls(n, longs)], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *[pa.nulls(1, t) for t in types], pa.nulls(1, ints),
             pa.nulls(1, ints), pa.array([all_pairs], longs), pa.array([sums], longs)], names)


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
           text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Aligned documents and the pair lists of their blocks (columns of ``_BLOCK_ROWS`` and
    ``block``); written."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    prepared(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, part, id_type = loaded(a_path, b_path), _Block(), 0, None
        for batch in it:
            id_type = batch.schema.field("doc_id").type
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for s, e in _portions(texts, CHARS_AT_ONCE):
                block.add(ids[s:e], Aligned(pair, texts[s:e]), texts[s:e])
                if block.chars >= block_chars:
                    yield from block.rows(part, id_type)
                    block, part = _Block(), part + 1
        if block.found:
            yield from block.rows(part, id_type)

    out = src.mapInArrow(batches, _BLOCK_ROWS.format(kind=kind))
    # the rows of a task stay in its partition, so partition and part name the block
    return written(out.withColumn("block", F.spark_partition_id().cast("long") * F.lit(1 << 31)
                                  + F.col("part")).drop("part"))


def pair_counts(listed: DataFrame) -> DataFrame:
    """``pair, count, best`` of the corpus from ``pair, links`` rows: how many links hold the pair,
    and whether no pair with the same B id has more. At most one row per A id and B id."""
    counts = listed.groupBy("pair").agg(F.sum("links").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("count") == F.max("count").over(
        Window.partitionBy(b_id)))


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                    text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document.

    ``n_best``: links whose pair is the most frequent of its B id in the corpus, ties included;
    ``count_sum``: sum of the corpus counts of the pairs of all links."""
    rows = blocks(docs, a_path, b_path, id_col, text_col, block_chars)
    kind = rows.schema["doc_id"].dataType.simpleString()
    listed = rows.where(F.col("pairs").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    back = listed.join(pair_counts(listed), "pair").select(
        F.col("block").alias("list"), "place", "count", "best")
    each = rows.where(F.col("pairs").isNull()).drop("pairs", "links")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros((2, len(place)), np.int64)
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        left = left.combine_chunks()
        codes, times = left.column("codes").combine_chunks(), left.column("times").combine_chunks()
        doc = np.repeat(np.arange(left.num_rows), codes.value_lengths().to_numpy())
        code, t = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def by_doc(values):
            out = np.zeros(left.num_rows, np.int64)
            np.add.at(out, doc, values)
            return pa.array(out)

        return pa.table({
            **{c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": by_doc(t * best[code]), "count_sum": by_doc(t * count[code]),
            "groups_sha256": left.column("groups_sha256")})

    return each.groupBy("block").cogroup(back.groupBy("list")).applyInArrow(
        one, _RESULT.format(kind=kind))
