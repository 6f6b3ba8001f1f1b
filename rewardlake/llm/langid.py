"""Operator 5: language identification by Bayesian fusion of evidence.

Four sources are combined per document: the text (byte-trigram likelihoods), the declared markup
language, the address suffix, and a prior of the host. A declared value is a language if at least
``MIN_TEXTS`` distinct texts declare it, whatever its share of the rows, and these hold ``MIN_TRIGRAMS``
trigrams. Likelihoods of the text come from a sample by hash of the texts of each language: its part
of ``SAMPLE_DOCS``, but ``LEAST_SAMPLE`` or all it has at least. Copies count once and a text of more
than ``TEXT_TRIGRAMS`` trigrams weighs as much as these; everything else comes from
grouped aggregation over all documents: soft counts of text-only posteriors by declared language, by
suffix and by host. Host priors are smoothed hierarchically, host to suffix to all: each level's
counts get ``KAPPA`` pseudo-rows spread as the level above says. As host and suffix are nested, the
suffix speaks through the host prior and is not counted twice.

Text evidence is tempered (``TEMPER`` effective trigrams at most), as trigrams are not independent.
A document is rejected if it has no letters, if its best language is none of the known ones
(an even distribution over trigrams stands for "other"), or if no language reaches ``MIN_PROB``;
languages of one primary subtag (en, en-us) reach it together. A document with letters that would be
rejected stays, with its declared value as language and the probability of "other", if that value is
a well-formed language tag with too few texts for a model.

Null text, declaration, suffix or host: that evidence says nothing. Repeated rows get equal results.
An empty table gives an empty result. Where no declared value is a language there is nothing to reject
by: documents with letters stay, with their declared value if well formed, else "und", and probability
0. The hosts' table grows with the data and is broadcast only up
to ``BROADCAST_BYTES``, else joined by shuffle with skew splitting.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from rewardlake.llm.common import F, run_arrow, written

SAMPLE_DOCS = 8_000
LEAST_SAMPLE = 500          # texts of a rare language that are sampled, if it has so many
TEXT_TRIGRAMS = 1_000       # a longer text is weighed down to so many
BINS = 1 << 14
TEMPER = 40.0
KAPPA = 20.0
MIN_PROB = 0.5
MIN_TEXTS = 5               # distinct texts and their trigrams that make a declared value a language
MIN_TRIGRAMS = 500
# Host priors up to so many bytes are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
UNIT = 1_000                # weighed counts are summed as whole thousandths, in any order alike
OTHER = "und"
NO_LANGUAGE = (OTHER, "mul", "mis", "zxx")      # tags that name no single language
_TAG = re.compile(r"[a-z]{2,8}(?:[-_][a-z0-9]{1,8})*")

# All bytes but letters become blanks; bytes of multi-byte characters stay.
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def trigram_bins(text: str | None) -> np.ndarray:
    """Bin numbers of the byte trigrams of the lower-cased letters, words set off by one blank."""
    raw = b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass")
                           .translate(_LETTERS).split()) + b" "
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


class TextModel:
    """Log-probabilities of trigram bins per language; the last row is the even "other"."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.log = np.vstack([np.log(p), np.full(BINS, -np.log(BINS))]).T.copy()

    def log_likelihood(self, text: str | None) -> np.ndarray:
        """Tempered log-likelihood of each language and "other"; zeros without letters."""
        bins = trigram_bins(text)
        if not len(bins):
            return np.zeros(len(self.languages) + 1)
        hist = np.bincount(bins, minlength=BINS)
        at = np.flatnonzero(hist)
        total = hist[at] @ self.log[at]
        return total * min(1.0, TEMPER / len(bins))


def text_hash() -> Column:
    """Non-negative hash of column ``text``."""
    return F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))


def well_formed(declared: str | None) -> bool:
    """Whether a declared value can name a language."""
    return bool(declared) and declared not in NO_LANGUAGE and bool(_TAG.fullmatch(declared))


def languages_of(rows: DataFrame) -> dict[str, int]:
    """Declared values with at least ``MIN_TEXTS`` distinct texts, and how many they have."""
    counts = (rows.where((F.col("declared") != "") & ~F.col("declared").isin(*NO_LANGUAGE)
                         & (F.trim("text") != ""))
              .select("declared", text_hash().alias("h")).distinct()
              .groupBy("declared").count().where(F.col("count") >= MIN_TEXTS).collect())
    return dict(sorted((r["declared"], r["count"]) for r in counts))


def train_text(rows: DataFrame, languages: dict[str, int],
               sample_docs: int = SAMPLE_DOCS) -> TextModel:
    """Weighed trigram counts per declared language, summed in Spark over a sample by hash of
    distinct texts; languages with too few trigrams get no model."""
    if not languages:
        return TextModel([], np.zeros((0, BINS)))
    total = sum(languages.values())
    bounds = rows.sparkSession.createDataFrame(
        [(c, i, min((1 << 63) - 1, int(2.0 ** 63 * min(
            1.0, max(sample_docs / total, LEAST_SAMPLE / n)))))
         for i, (c, n) in enumerate(languages.items())], "declared string, lang int, below long")
    chosen = (rows.select("text", "declared", text_hash().alias("h"))
              .join(F.broadcast(bounds), "declared").where(F.col("h") <= F.col("below")))

    def once(it):                       # copies within a task go before texts are shuffled
        seen: set[tuple[int, int]] = set()
        for b in it:
            keep = []
            for key in zip(b.column("h").to_pylist(), b.column("lang").to_pylist()):
                keep.append(key not in seen)
                seen.add(key)
            yield b.filter(pa.array(keep, pa.bool_()))

    def partial(it):
        counts = np.zeros((len(languages), BINS), np.int64)
        for b in it:
            for t, c in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                own = np.bincount(trigram_bins(t), minlength=BINS)
                weight = UNIT * min(1.0, TEXT_TRIGRAMS / max(1, own.sum()))
                counts[c] += np.rint(own * weight).astype(np.int64)
        lang, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(at, pa.int32()),
             pa.array(counts[lang, at], pa.int64())], ["lang", "bin", "n"])

    sums = (chosen.select("h", "lang", "text").mapInArrow(once, "h long, lang int, text string")
            .dropDuplicates(["h", "lang"]).select("text", "lang")
            .mapInArrow(partial, "lang int, bin int, n long")
            .groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect())   # languages * BINS
    counts = np.zeros((len(languages), BINS))
    for r in sums:
        counts[r["lang"], r["bin"]] = r["n"] / UNIT
    enough = counts.sum(axis=1) >= MIN_TRIGRAMS
    return TextModel([c for c, e in zip(languages, enough) if e], counts[enough])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def text_posteriors(rows: DataFrame, model: TextModel) -> DataFrame:
    """``declared, suffix, host, p``: text-only posteriors, without the texts; written."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = [_softmax(model.log_likelihood(t)[:-1]).tolist()
             for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column("declared"), b.column("suffix"), b.column("host"),
             pa.array(p, pa.list_(pa.float64()))], ["declared", "suffix", "host", "p"])

    return written(run_arrow(rows.select("text", "declared", "suffix", "host"), run,
                             "declared string, suffix string, host string, p array<double>"))


def host_priors(posteriors: DataFrame, n_lang: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Host priors ``host, suffix, prior`` by hierarchical smoothing, the overall prior and the
    table of declared values given the language."""
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n_lang)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n_lang)]
    hosts = written(posteriors.groupBy("host", "suffix").agg(*sums))
    vec = lambda r: np.array([r[f"s{i}"] or 0.0 for i in range(n_lang)])           # noqa: E731
    overall = vec(hosts.agg(*again).first()) + 1.0
    overall = overall / overall.sum()
    above = F.array(*[F.lit(float(x)) for x in overall])

    def smoothed(prefix: str, parent: Column) -> Column:
        own = F.array(*[F.col(f"{prefix}{i}") for i in range(n_lang)])
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda x, up: (x + KAPPA * up) / (total + KAPPA))

    by_suffix = hosts.groupBy("suffix").agg(*again).select(
        F.col("suffix").alias("_suffix"), F.when(F.col("suffix").isNull(), above).otherwise(smoothed("s", above))
        .alias("up"))
    priors = hosts.join(by_suffix, F.col("suffix").eqNullSafe(F.col("_suffix"))).select(
        "host", "suffix", F.when(F.col("host").isNull(), F.col("up")).otherwise(smoothed("s", F.col("up")))
        .alias("prior"))
    return written(priors), overall, vec


def identify_batches(model: TextModel, overall: np.ndarray, says: dict[str, np.ndarray]):
    """Function from (text, declared, prior) to (language, probability, accepted)."""
    names = [*model.languages, OTHER]
    primary = [re.split("[-_]", c)[0] for c in names]
    family = np.array([primary.index(c) for c in primary])

    def one(text, declared, prior) -> tuple[str, float, bool]:
        letters = bool(text) and any(c.isalpha() for c in text)
        if not model.languages:
            return declared if letters and well_formed(declared) else OTHER, 0.0, letters
        text_like = model.log_likelihood(text)
        p = np.array(prior if prior is not None else overall, dtype=float)
        z = text_like + np.log(np.append(p * 0.99, 0.01))
        if declared in says:
            z = z + says[declared]
        post = _softmax(z)
        top = np.bincount(family, post)
        best = int(np.argmax(np.where(family == np.argmax(top), post, -1.0)))
        prob = float(top[family[best]])
        if letters and (names[best] == OTHER or prob < MIN_PROB) and (
                declared not in says and well_formed(declared)):
            return declared, float(post[-1]), True
        return names[best], prob, bool(letters and names[best] != OTHER and prob >= MIN_PROB)
    return one


def broadcast_hosts(n_lang: int) -> int:
    """How many hosts' priors over ``n_lang`` languages are within ``BROADCAST_BYTES``, as Python
    objects (a float takes 32 bytes with its place in a list)."""
    return max(1, BROADCAST_BYTES // (32 * n_lang + 200))


class Fusion:
    """All that is learned from a corpus."""

    def __init__(self, rows: DataFrame, sample_docs: int = SAMPLE_DOCS):
        """``rows`` has text, declared, suffix and host."""
        self.text = train_text(rows, languages_of(rows), sample_docs)
        self.languages = languages = self.text.languages
        if not languages:
            self.priors = rows.sparkSession.createDataFrame(
                [], "host string, suffix string, prior array<double>")
            self.overall, self.says = np.zeros(0), {}
            return
        post = text_posteriors(rows, self.text)
        n = len(languages)
        self.priors, self.overall, vec = host_priors(post, n)
        declared = post.where(F.col("declared").isin(languages)).groupBy("declared").agg(
            *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]).collect()
        table = np.array([vec(r) for r in declared]).reshape(-1, n) + 1.0
        given = np.log(table / table.sum(axis=0))          # log P(declared | language)
        self.says = {r["declared"]: np.append(g, g.mean()) for r, g in zip(declared, given)}

    def with_prior(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prior of their host and suffix."""
        few = self.priors.count() <= broadcast_hosts(len(self.languages))
        p = self.priors.withColumnsRenamed({"host": "_h", "suffix": "_s", "prior": "_prior"})
        return rows.join(F.broadcast(p) if few else p,
                         F.col("host").eqNullSafe(F.col("_h"))
                         & F.col("suffix").eqNullSafe(F.col("_s")), "left").drop("_h", "_s")


def evidence(df: DataFrame, text: Column, declared: Column | None = None,
             suffix: Column | None = None, host: Column | None = None) -> DataFrame:
    """``df`` with the evidence columns; those not given are null."""
    none = F.lit(None).cast("string")
    as_text = lambda c: none if c is None else F.lower(F.trim(c.cast("string")))
    return df.select("*", text.cast("string").alias("text"), as_text(declared).alias("declared"),
                     as_text(suffix).alias("suffix"), as_text(host).alias("host"))


def identify(rows: DataFrame, id_col: str, fusion: Fusion) -> DataFrame:
    """``<id_col>, lang, prob, accepted`` for rows with evidence columns."""
    one = identify_batches(fusion.text, fusion.overall, fusion.says)
    src = fusion.with_prior(rows.select(id_col, "text", "declared", "suffix", "host"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(*x) for x in zip(b.column("text").to_pylist(),
                                    b.column("declared").to_pylist(),
                                    b.column("_prior").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [b.column(id_col), pa.array([g[0] for g in got], pa.string()),
             pa.array([g[1] for g in got], pa.float64()),
             pa.array([g[2] for g in got], pa.bool_())], [id_col, "lang", "prob", "accepted"])

    return run_arrow(src, run, f"`{id_col}` {kind}, lang string, prob double, accepted boolean")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of ``documents``: ``lang`` is the declaration and ``source`` the host; there is no
    address, so the suffix is unknown."""
    return evidence(docs.select("doc_id", F.col("text").alias("_t"), "lang", "source"),
                    F.col("_t"), F.col("lang"), None, F.col("source")).drop("_t", "lang", "source")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages``: the declaration from the html tag, host and suffix from the address,
    and the text without scripts, styles, comments and tags."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1)
    return evidence(pages.select("page_id", "url", "html"), body,
                    F.when(declared != "", declared), F.element_at(F.split(host, r"\."), -1),
                    host).drop("url", "html")


def accepted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` (columns of documents, any more) that are accepted; ``lang`` becomes
    the language found."""
    rows = evidence(docs.select(F.col("text").alias("_t"), "lang", "source"), F.col("_t"),
                    F.col("lang"), None, F.col("source")).drop("_t", "lang", "source")
    fusion = Fusion(rows, sample_docs)
    one = identify_batches(fusion.text, fusion.overall, fusion.says)
    schema = docs.schema
    most = broadcast_hosts(len(fusion.languages))
    priors = {(r["host"]): r["prior"] for r in fusion.priors.limit(most + 1).collect()}
    joined = len(priors) > most
    # columns of our own, named unlike any of the input's
    name = "_" * (1 + max(len(c) for c in docs.columns))
    with_prior = docs
    if joined:
        keyed = docs.withColumn(f"{name}of", F.lower(F.trim(F.col("source").cast("string"))))
        p = fusion.priors.select(F.col("host").alias(f"{name}host"),
                                 F.col("prior").alias(f"{name}prior"))
        with_prior = keyed.join(p, F.col(f"{name}of").eqNullSafe(F.col(f"{name}host")), "left").drop(
            f"{name}host", f"{name}of")
        priors = {}                     # not sent to the tasks besides

    def batches(it):
        for b in it:
            at = b.schema.get_field_index
            lang, src = (b.column(at(c)).to_pylist() for c in ("lang", "source"))
            clean = lambda v: None if v is None else str(v).strip().lower()         # noqa: E731
            prior = (b.column(at(f"{name}prior")).to_pylist() if joined
                     else [priors.get(clean(s)) for s in src])
            got = [one(t, clean(c), p) for t, c, p in
                   zip(b.column(at("text")).to_pylist(), lang, prior)]
            out = b.set_column(at("lang"), b.schema.field(at("lang")),
                               pa.array([g[0] for g in got], b.schema.field(at("lang")).type))
            if joined:
                out = out.select([f.name for f in schema])
            yield out.filter(pa.array([g[2] for g in got], pa.bool_()))

    return with_prior.mapInArrow(batches, schema)
