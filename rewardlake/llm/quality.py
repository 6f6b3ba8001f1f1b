"""Operator 7: quality classifier from weak labels.

Heuristic labellers vote on every document (1 good, -1 bad, 0 abstains). Votes are counted per
pattern in Spark; expectation-maximisation over the patterns estimates the labellers' accuracies.
Posterior labels of a bounded sample (``SAMPLE_DOCS`` by hash of the text, at most half of them of
each class) train a linear scorer on hashed features: byte trigrams and bucketed measures. The
scorer then scores every whole document; those below ``REJECT_BELOW`` are rejected.

No hand labels are used; ``labels`` only serve to measure accuracy in tests. Null and empty texts
have no features and get the scorer's bias; they are rejected as they hold nothing to keep. Repeated
rows get equal scores. An empty table gives an empty result. All columns are kept by
:func:`accepted`.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rewardlake.llm.common import F, run_arrow, text_of, written
from rewardlake.llm.weak import LabelModel, fit_logistic, hashed

SAMPLE_DOCS = 4_000
BUCKETS = 2048
REJECT_BELOW = 0.2            # clean documents should stay

# Frequent words of the supported languages.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on with as be by this are or an not "
    "der die das und ist nicht mit den von zu ein eine auf für im dem des auch "
    "le la les et est de des un une dans que pour qui sur pas au du en "
    "el los las y es en un una del que por con para se su al lo".split())
SYMBOLS = b"#$%&*|{}<>^~\\=+_@"
VARIETY_WORDS = 400         # different words are counted per stretch, as their share falls with length
MEASURES = ("symbols", "capitals", "bangs", "bars", "repeats", "stops", "word_length", "ends", "variety")


def measures(text: str) -> np.ndarray:
    """Shares that the labellers look at, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, chars = len(words), max(1, len(raw))
    if not n:
        return np.zeros(len(MEASURES))
    bare = len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    repeats = sum(map(str.__eq__, words, words[1:]))
    stops = sum(map(STOP_WORDS.__contains__, words))
    return np.array([
        (len(raw) - bare) / chars, upper / max(1, upper + lower), text.count("!!") / n,
        words.count("|") / n, repeats / n, stops / n, chars / n,
        (text.count(".") + text.count("?") + text.count("!")) / n,
        sum(len(set(words[i:i + VARIETY_WORDS])) for i in range(0, n, VARIETY_WORDS)) / n])


def votes(m: np.ndarray, words: int) -> list[int]:
    """One vote per labeller. Most know one defect and abstain where they do not see it; running
    prose (frequent words, sentence ends) speaks for a document."""
    symbols, capitals, bangs, bars, repeats, stops, length, ends, variety = m
    long = words >= 8
    return [
        -1 if symbols > 0.05 else 0,
        -1 if long and capitals > 0.3 else 0,
        -1 if long and bangs > 0.1 else 0,
        -1 if bars > 0.08 else 0,
        -1 if long and repeats > 0.2 else 0,
        1 if long and stops > 0.08 and repeats < 0.1 else -1 if words >= 30 and stops < 0.02 else 0,
        -1 if length > 25 or 0 < length < 2.5 else 0,
        1 if (long and 0.01 < ends < 0.3 and symbols < 0.01 and bangs == 0 and bars == 0
              and repeats < 0.05) else 0,
        -1 if words >= 20 and variety < 0.15 else 0,
    ]


def features(text: str, m: np.ndarray) -> np.ndarray:
    """Hashed features: damped byte-trigram counts of unit length, and bucketed measures."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    x = np.zeros(BUCKETS, np.float32)
    if len(b) >= 3:
        for s in range(0, len(b) - 2, 1 << 20):
            part = b[s:s + (1 << 20) + 2].astype(np.uint32)
            code = (part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77)
                    ^ part[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            x += np.bincount(code >> np.uint32(32 - 11), minlength=BUCKETS).astype(np.float32)
        x = np.log1p(x)
        x /= np.sqrt((x * x).sum())
    for name, value in zip(MEASURES, m):
        x[hashed(f"{name} {int(min(40, np.ceil(20 * value)))}", BUCKETS)] += 1.0
    return x


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    labels: LabelModel

    def score(self, text: str | None) -> float:
        """Probability that the document is good; 0 without words."""
        if not text or not text.strip():
            return 0.0
        z = float(features(text, measures(text)) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def vote_table(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``votes, h, x``: the votes on every document, a hash of its text, and the features of about
    four times ``sample_docs`` documents of the smallest hashes, once per text and task; written."""
    n = docs.count()
    below = int(2 ** 63 * min(1.0, 4 * sample_docs / max(1, n)))
    src = docs.select(text_of(text_col).alias("text")).where(F.col("text") != "")
    src = src.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)))

    def batches(it):
        seen: set[int] = set()          # sampled texts of this task: copies need no features
        for b in it:
            vs, xs = [], []
            for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
                m = measures(t)
                vs.append(votes(m, len(t.split())))
                new = h < below and h not in seen
                if new:
                    seen.add(h)
                xs.append(features(t, m).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(vs, pa.list_(pa.int32())), b.column("h"), pa.array(xs, pa.binary())],
                ["votes", "h", "x"])

    return written(src.mapInArrow(batches, "votes array<int>, h long, x binary"))


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Label model over all documents, scorer on a bounded sample of posterior labels."""
    table = vote_table(docs, text_col, sample_docs)
    patterns = table.groupBy("votes").count().collect()             # 3**9 at most
    pat = np.array([list(r["votes"]) for r in patterns], int).reshape(-1, len(MEASURES))
    counts = np.array([r["count"] for r in patterns], float)
    labels = LabelModel(len(MEASURES), prior=0.85).fit(pat, counts, [""] * len(pat))
    good = labels.posterior(pat, [""] * len(pat))
    x, y = [], []
    sample = table.where(F.col("x").isNotNull())
    for side in (good >= 0.5, good < 0.5):
        chosen = [list(map(int, p)) for p in pat[side]]
        if not chosen:
            continue
        known = table.sparkSession.createDataFrame(
            [(v, float(g)) for v, g in zip(chosen, good[side])], "votes array<int>, good double")
        own = sample.join(F.broadcast(known), "votes")
        # hashes first (longs only), so that no more features than wanted reach the driver
        hashes = np.sort([r["h"] for r in own.select("h").distinct().collect()])
        if not len(hashes):
            continue
        last = int(hashes[min(len(hashes), sample_docs // 2) - 1])
        rows = own.where(F.col("h") <= last).dropDuplicates(["h"]).select("x", "good").collect()
        x += [np.frombuffer(r["x"], np.float32) for r in rows]
        y += [r["good"] for r in rows]
        del rows
    weights, bias = fit_logistic(np.array(x, np.float32).reshape(-1, BUCKETS), np.array(y))
    return Scorer(weights.astype(np.float32), bias, labels)


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, score, accepted`` of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([scorer.score(t) for t in b.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(s), pa.array(s >= REJECT_BELOW)],
            ["doc_id", "score", "accepted"])

    return run_arrow(src, rows, f"doc_id {kind}, score double, accepted boolean")


def accepted(docs: DataFrame, text_col: str = "text",
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on them, keeps; all columns."""
    scorer = fit(docs, text_col, sample_docs)

    def batches(it):
        for b in it:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            keep = [scorer.score(t) >= REJECT_BELOW for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
