"""Operator 3: sum-of-squares packing of tokenised documents into fixed-size sequences.

Documents become token ids plus a closing id; only those longer than a sequence are cut. Pieces
that fill a sequence stand alone. The others are dealt evenly into groups whose number grows with
the data; each group is packed by the sum-of-squares rule, longest piece first: of the open
sequences that can take the piece, it goes where the sum over residual gaps of (number of open
sequences with that gap) squared becomes smallest, ties to the smaller gap; a sequence is opened
only when none can take it. (The unrestricted rule may also open one for the sake of the sum; with
2,048 possible gaps that leaves far more sequences, so it is off by default: ``may_open``.)

Null and empty texts have only the closing id. Repeated rows are packed like any others, each
once. An empty table gives an empty result. Columns besides id and text are ignored.
"""
from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rewardlake.llm.common import F, n_groups, prepared, run_arrow, text_of, written

SEQUENCE_TOKENS = 2048
PIECES_PER_GROUP = 16_384
# Of wide pieces packed inside their task: tokens of a group (bounds memory), and the gap up to
# which a sequence is left as it is.
TOKENS_PER_GROUP = 1_000_000
SMALL_GAP = 16
# Word-cache entries of a worker and characters tokenised at once (bound memory, not results).
CACHE_ENTRIES = 900_000
CHARS_AT_ONCE = 4_000_000
# Longer words are not kept for further batches.
KEPT_CHARS = 64
# The same where token ids come out too and share a worker's memory.
WIDE_CACHE_ENTRIES = 150_000
WIDE_CHARS_AT_ONCE = 1_000_000

MARKS = ".,!?;:*$#&%|"
# Separators of str.split that the tokenizers' white-space class lacks.
_ODD_SPLIT = re.compile("[\x1c-\x1f]")


def _letters(word: str) -> bool:
    """Whether ``word`` has only letters, also after normalisation and lower-casing."""
    return word.isalpha() and (
        word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Token ids of whole texts for a tokenizer that drops white space and never joins over it.

    A text is therefore encoded stretch by stretch between white space, each distinct stretch
    once per batch; the library encodes the ones not met before. The ids of whole stretches are kept
    in two halves of bounded size, so that a batch goes one by one only through the stretches that
    the young half lacks."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.half, self.young, self.old = entries // 2, {}, {}
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)      # tokens that end a word
        for t, i in vocab.items():
            self.last[i] = t.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As ``_encode`` for words of letters: encoded side by side, and cut after each token
        that ends a word."""
        lines = [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)]
        flat = b"".join(self._encode(lines))
        cuts = (4 * (np.flatnonzero(self.last[np.frombuffer(flat, "<u4")]) + 1)).tolist()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts)]

    def _learn(self, fresh: set[str]) -> list[str]:
        """Puts the ids of words that are not among the young ones there; returns those that are
        too long to stay."""
        young, old = self.young, self.old
        two, letters, other = {}, set(), set()
        for w in fresh:
            got = old.get(w)
            if got is not None:
                young[w] = got
                continue
            if w.isalpha() and w.isascii():
                letters.add(w)
                continue
            # letters, then marks: two pre-tokens, looked up by themselves
            stem = w.rstrip(MARKS)
            if not stem or not _letters(stem):
                other.add(w)
                continue
            tail = w[len(stem):]
            if not tail:
                letters.add(w)
                continue
            two[w] = stem, tail
            for part, unknown in ((stem, letters), (tail, other)):
                if part not in young:
                    got = old.get(part)
                    if got is None:
                        unknown.add(part)
                    else:
                        young[part] = got
        for words, encode in ((list(letters), self._encode_words), (list(other), self._encode)):
            young.update(zip(words, encode(words), strict=True))
        for w, (stem, tail) in two.items():
            young[w] = young[stem] + young[tail]
        return [w for words in (letters, other, two) for w in words if len(w) > KEPT_CHARS]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD_SPLIT.search(t) else t.split() for t in texts]
        distinct: set[str] = set()
        for words in split:
            distinct.update(words or ())
        fresh = distinct.difference(self.young)
        if len(self.young) + len(fresh) > self.half and self.young:
            # the young half is full: it becomes the old one, and what is met again moves back
            self.young, self.old = {}, self.young
            fresh = distinct
        long = self._learn(fresh)
        ids = self.young.__getitem__
        out = [self._encode([t])[0] if words is None else b"".join(map(ids, words))
               for t, words in zip(texts, split)]
        for w in long:
            del self.young[w]
        return out


_LOADED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, entries: int = CACHE_ENTRIES) -> WordIds:
    if (path, entries) not in _LOADED:
        _LOADED[path, entries] = WordIds(path, entries)
    return _LOADED[path, entries]


def _cutting(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, budget: int,
             eos_id: int, with_ids: bool):
    """Ids and texts, the function from a batch of them to their pieces, and its schema."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
              + (", ids array<int>" if with_ids else ""))
    close = np.array([eos_id], dtype="<u4").tobytes()
    entries, most = ((WIDE_CACHE_ENTRIES, WIDE_CHARS_AT_ONCE) if with_ids
                     else (CACHE_ENTRIES, CHARS_AT_ONCE))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        encode = word_ids(tokenizer_path, entries)
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        texts = b.column("text").to_pylist()
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= most):
                chars += len(texts[j])
                j += 1
            for at, packed in enumerate(encode(texts[i:j]), i):
                packed += close
                for p, s in enumerate(range(0, len(packed), 4 * budget)):
                    part = packed[s:s + 4 * budget]
                    row.append(at)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype("int32"))
            i = j
        cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names)

    return src, rows, schema


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           budget: int = SEQUENCE_TOKENS, eos_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: the pieces of every whole text."""
    return run_arrow(*_cutting(docs, tokenizer_path, id_col, text_col, budget, eos_id, with_ids))


def sum_of_squares(lengths, budget: int, may_open: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, packed longest first."""
    lengths = np.asarray(lengths, dtype=np.int64)
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(budget + 1, np.int64)              # open sequences by residual gap
    open_at: list[list[int]] = [[] for _ in range(budget + 1)]
    n_open = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # gaps size..budget-1; taking the piece moves one sequence from gap g to gap g - size
        here, there = count[size:budget], count[0:budget - size]
        delta = 2 * (there - here) + 2
        if len(delta):
            delta[0] = 1 - 2 * here[0]                  # a filled sequence is no longer open
            delta = np.where(here > 0, delta, np.iinfo(np.int64).max)
            best = int(np.argmin(delta))
            found = here[best] > 0
        else:
            found = False
        if found and may_open and size < budget and 2 * count[budget - size] + 1 < delta[best]:
            found = False
        if found:
            gap = size + best
            s = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, s = budget, n_open
            n_open += 1
        seq[i], offset[i] = s, budget - gap
        if gap > size:
            open_at[gap - size].append(s)
            count[gap - size] += 1
    return seq, offset


def pack(parts: DataFrame, budget: int = SEQUENCE_TOKENS, per_group: int = PIECES_PER_GROUP,
         may_open: bool = False) -> DataFrame:
    """``parts`` (columns of :func:`pieces`) with ``sequence_id`` and ``offset``.

    Groups hold numbers only: where ``parts`` has arrays (token ids), a group gets row numbers and
    lengths, and the places found are joined to the written pieces by row number."""
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()))
    partial = parts.where(F.col("length") < budget)
    groups = n_groups(partial.count(), per_group)
    wide = any(f.dataType.typeName() in ("array", "binary", "string") for f in parts.schema)
    own = [f for f in parts.schema if f.name != "_row"]
    carried = [f for f in parts.schema if f.name in ("_row", "length")] if wide else own
    out = [f.name for f in own] + ["sequence_id", "offset"]
    # the row number deals the rows of each partition evenly over the groups
    dealt = partial.select("_row", *[f.name for f in carried if f.name != "_row"],
                           F.pmod("_row", F.lit(groups)).cast("int").alias("_group"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + (
        ", sequence_id long, offset long")
    names = [f.name for f in carried] + ["sequence_id", "offset"]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        seq, at = sum_of_squares(pdf["length"].to_numpy(), budget, may_open)
        # even numbers below belong to the groups, odd ones to the full pieces
        pdf = pdf.assign(sequence_id=(seq * groups + int(key[0])) * 2, offset=at)
        return pdf[names]

    packed = dealt.groupBy("_group").applyInPandas(one, schema)
    if wide:
        packed = partial.join(written(packed.drop("length")), "_row")
    full = (parts.where(F.col("length") >= budget)
            .withColumn("sequence_id", F.col("_row") * 2 + 1)
            .withColumn("offset", F.lit(0).cast("long")))
    return full.select(*out).unionByName(packed.select(*out))


def _placed_in_task(it, budget: int):
    """Batches of pieces with ``_local`` (the number of the piece's sequence in this task) and
    ``_at`` (its place there): pieces are gathered into groups and packed. Both are null for the
    pieces of sequences that are left with a gap above ``SMALL_GAP``."""
    held, n_pieces, n_tokens, made = [], 0, 0, 0

    def placed():
        nonlocal made
        b = pa.Table.from_batches(held).combine_chunks()
        lengths = b.column("length").to_numpy()
        seq, at = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        part = lengths < budget
        seq[part], at[part] = sum_of_squares(lengths[part], budget)
        n = int(seq[part].max()) + 1 if part.any() else 0
        seq[~part] = n + np.arange((~part).sum())
        gap = budget - np.bincount(seq, weights=lengths)
        left = gap[seq] > SMALL_GAP
        for name, x in (("_local", seq + made), ("_at", at)):
            b = b.append_column(name, pa.array(x, pa.int64(), mask=left))
        made += len(gap)
        held.clear()
        return b.to_batches()

    for batch in it:
        # a batch is cut where a group is full, so that a group is bounded whatever the batches are
        tokens = batch.column("length").to_numpy()
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(tokens[at:]), TOKENS_PER_GROUP - n_tokens) + 1
            n = int(min(room, PIECES_PER_GROUP - n_pieces, batch.num_rows - at))
            held.append(batch.slice(at, n))
            n_pieces, n_tokens = n_pieces + n, n_tokens + int(tokens[at:at + n].sum())
            at += n
            if n_pieces >= PIECES_PER_GROUP or n_tokens >= TOKENS_PER_GROUP:
                yield from placed()
                n_pieces = n_tokens = 0
    if held:
        yield from placed()


def pack_in_tasks(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                  text_col: str = "text", budget: int = SEQUENCE_TOKENS, eos_id: int = 0
                  ) -> DataFrame:
    """Pieces with their token ids, which hardly any leave their task: each task tokenises and packs
    its pieces group by group in one Python stage, and only those whose sequence it cannot fill
    are packed again together with the other tasks'."""
    src, rows, schema = _cutting(docs, tokenizer_path, id_col, text_col, budget, eos_id, True)
    prepared(docs.sparkSession)
    placed = src.mapInArrow(
        lambda it: _placed_in_task((rows(b) for b in it if b.num_rows), budget),
        f"{schema}, _local long, _at long")
    # numbers of a task's sequences are told apart by its partition; odd here, even below
    number = (F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("_local")) * 2 + 1
    placed = written(placed.withColumn("sequence_id", number).withColumnRenamed("_at", "offset")
                     .drop("_local"))
    rest = pack(placed.where(F.col("offset").isNull()).drop("sequence_id", "offset"), budget)
    return placed.where(F.col("offset").isNotNull()).unionByName(
        rest.withColumn("sequence_id", F.col("sequence_id") * 2))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", budget: int = SEQUENCE_TOKENS, eos_id: int = 0,
                   with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place, and with its token ids if
    ``with_ids``."""
    if with_ids:
        return pack_in_tasks(docs, tokenizer_path, id_col, text_col, budget, eos_id)
    return pack(pieces(docs, tokenizer_path, id_col, text_col, budget, eos_id), budget)
