"""Operator 10: personal data by weak supervision.

Base spans are the leftmost non-overlapping matches of four fixed patterns that pass their checks.
Wider patterns give further candidates (local phone numbers, written-out addresses, account and
identity numbers, names behind a title). Five labellers vote on every candidate: strict pattern,
checksum or value range, gazetteer, context words and token borders. Expectation-maximisation over
the counts of vote patterns estimates their reliabilities; its posteriors label a bounded sample of
candidates (``TRAIN_SPANS``, the smallest by hash) that trains the final hashed span classifier.
Base spans always stay; other candidates that touch none are added if the classifier gives them at
least ``ADD_AT``. Of wider candidates that overlap, the kind that comes first in ``FIRST`` stands; within
a kind matches do not overlap, the leftmost stands.

Texts are scanned whole and in linear time: the matches of a kind and the spans taken so far are
both in order and swept once per kind. Null texts count as empty; null ids stay null; repeated
rows are scanned each; an empty table gives an empty result. :func:`redact` keeps all columns.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rewardlake.llm.common import F, least_hashed, run_arrow, text_of, written
from rewardlake.llm.weak import LabelModel, fit_logistic, hashed

# The base kinds in their order.
BASE = ("email", "ip", "card", "phone")
MORE = ("written_email", "local_phone", "number", "identity", "iban", "name")
KINDS = BASE + MORE
# Which of two overlapping wider candidates stands.
FIRST = ("written_email", "number", "iban", "identity", "local_phone", "name")

TRAIN_SPANS = 20_000
BUCKETS = 1024
ADD_AT = 0.9
CONTEXT = 32                # characters looked at on either side

# Default gazetteers; every function below takes others of the same form.
GAZETTEER = {
    "suffix": frozenset("com org net edu gov io info biz de fr es uk us eu ch at it nl be se no dk "
                        "fi pl pt ie ca au nz jp cn in br mx ar".split()),
    "country_code": frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 "
                              "55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 "
                              "420 421 971 972".split()),
    "given_name": frozenset("james mary john linda robert anna michael maria david laura thomas "
                            "julia peter sophie hans claire pierre carmen jose lucia".split()),
}
CUES = re.compile(
    r"(?i)\b(e-?mail|mail|contact|call|phone|tel|telephone|mobile|fax|reach|write to|card|visa|"
    r"credit|payment|account|iban|ssn|social security|passport|identity|ip|address|host|server|"
    r"name|anruf|telefon|konto|karte|courriel|carte|compte|correo|tarjeta|cuenta)\b")
DECOYS = re.compile(r"(?i)\b(version|isbn|issn|order|serial|part no|invoice|page|figure|section|"
                    r"chapter|total|sum|item|sku)\b")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"(?i)[(\[]at[)\]]")
_WRITTEN = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[a-z0-9-]{1,63}"
                      r"(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]{2,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9])(?:\([0-9]{2,5}\) ?|[0-9]{3,4}[ .-])[0-9]{3,4}[ .-]"
                          r"[0-9]{3,4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
                   r"(?![A-Za-z0-9])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|M|Sr|Sra|Don)\.? ([A-Z][a-z]{1,20})"
                   r"(?: [A-Z][a-z]{1,20})?\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn: the local part is the run of its characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Chains of digit groups with single dots between, four groups to a match."""
    out = []
    if "." not in text:
        return out
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        chain: list[tuple[int, int]] = []
        for g in _DIGITS.finditer(text, run.start(), run.end()):
            if chain and g.start() != chain[-1][1] + 1:
                chain = []
            chain.append(g.span())
            if len(chain) == 4:
                parts = [text[a:b].lstrip("0") or "0" for a, b in chain]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    out.append((chain[0][0], chain[-1][1]))
                chain = []
    return out


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _only_digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text)
              if 9 <= len(_only_digits(m[0])) <= 15] if "+" in text else []
    return {"email": _emails(text), "ip": _ips(text), "card": cards, "phone": phones}


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple = ()
    features: list = field(default_factory=list)


def _votes(text: str, c: Candidate, gazetteer: dict) -> tuple:
    """Votes of the five labellers: 1 personal, -1 not, 0 abstains."""
    s = text[c.start:c.end]
    digits = _only_digits(s)
    strict = 1 if c.kind in BASE else 0
    check, gaz = 0, 0
    if c.kind == "email":
        suffix = s.rpartition(".")[2].lower()
        check = 1 if ".." not in s and s[0] not in ".-" else -1
        gaz = 1 if suffix in gazetteer["suffix"] else -1
    elif c.kind == "written_email":
        gaz = 1 if re.split(r"[^a-z0-9]+", s.lower())[-1] in gazetteer["suffix"] else -1
    elif c.kind == "ip":
        check = -1 if s.startswith(("0.", "127.", "255.")) else 1
    elif c.kind in ("card", "number"):
        check = 1 if luhn(digits) else -1
        gaz = 1 if digits[0] in "3456" else -1
    elif c.kind in ("phone", "local_phone"):
        check = 1 if len(set(digits)) > 3 else -1
        gaz = 0 if c.kind == "local_phone" else (
            1 if any(digits[:n] in gazetteer["country_code"] for n in (1, 2, 3)) else -1)
    elif c.kind == "identity":
        check = -1 if digits[:3] in ("000", "666") or digits[3:5] == "00" else 1
    elif c.kind == "iban":
        check = 1 if _mod97(s) else -1
    elif c.kind == "name":
        gaz = 1 if any(w.lower() in gazetteer["given_name"] for w in s.split()) else 0
    before = text[max(0, c.start - CONTEXT):c.start]
    cue = 1 if CUES.search(before) else (-1 if DECOYS.search(before) else 0)
    prev = text[c.start - 1:c.start]
    after = text[c.end:c.end + 1]
    border = -1 if prev.isalnum() or after.isalnum() else 1
    return (strict, check, gaz, cue, border)


def _features(text: str, c: Candidate) -> list[int]:
    s = text[c.start:c.end]
    shape = re.sub(r"(.)\1+", r"\1", "".join(
        "9" if x.isdigit() else "a" if x.islower() else "A" if x.isupper() else x for x in s[:40]))
    prev = text[max(0, c.start - 24):c.start].split()[-1:]
    after = text[c.end:c.end + 24].split()[:1]
    names = [f"k {c.kind}", f"s {c.kind} {shape}", f"n {c.kind} {(c.end - c.start) // 4}",
             f"p {c.kind} {prev}", f"a {c.kind} {after}"]
    names += [f"v {c.kind} {j} {v}" for j, v in enumerate(c.votes)]
    return [hashed(n, BUCKETS) for n in names]


def _wide(text: str) -> dict[str, list[tuple[int, int]]]:
    """The matches of the wider patterns, each kind in order."""
    return {
        "written_email": [m.span() for m in _WRITTEN.finditer(text)] if _AT.search(text) else [],
        "number": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13
                   and 13 <= len(_only_digits(m[0])) <= 19],
        "iban": [m.span() for m in _IBAN.finditer(text)],
        "identity": [m.span() for m in _IDENTITY.finditer(text)],
        "local_phone": [m.span() for m in _LOCAL_PHONE.finditer(text)],
        "name": [m.span() for m in _NAME.finditer(text)]}


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the ordered ``spans`` that overlap none of the ordered, disjoint ``taken``."""
    out, i = [], 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap joined into one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):              # two or more ordered runs: linear
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def candidates_of(text: str, gazetteer: dict = GAZETTEER) -> list[Candidate]:
    """Base spans and, where they touch none, wider candidates; with votes and features."""
    found = base_spans(text)
    out = [Candidate(k, a, b) for k in BASE for a, b in found[k]]
    taken = _merged([(c.start, c.end) for c in out])
    wide = _wide(text)
    for kind in FIRST:
        free = _free(wide[kind], taken)
        if free:
            out += [Candidate(kind, a, b) for a, b in free]
            taken = _merged(taken + free)
    for c in out:
        c.votes = _votes(text, c, gazetteer)
        c.features = _features(text, c)
    return out


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def keeps(self, kind: str, features: list[int]) -> bool:
        if kind in BASE:
            return True
        z = self.bias + self.weights[features].sum()
        return bool(1 / (1 + np.exp(-np.clip(z, -50, 50))) >= ADD_AT)


_CANDS = ("array<struct<kind:string,start:int,end:int,votes:array<int>,features:array<int>>>")


_CAND = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])


def _column(texts: list, gazetteer: dict) -> pa.Array:
    """The candidates of each text; null texts have none."""
    return pa.array([[{"kind": c.kind, "start": c.start, "end": c.end, "votes": list(c.votes),
                       "features": c.features} for c in candidates_of(t or "", gazetteer)]
                     for t in texts], pa.list_(_CAND))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               gazetteer: dict = GAZETTEER) -> DataFrame:
    """``doc_id, cands`` of every document; written, without the texts."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), _column(b.column("text").to_pylist(), gazetteer)],
            ["doc_id", "cands"])

    return written(run_arrow(src, rows, f"doc_id {kind}, cands {_CANDS}"))


def fit(cands: DataFrame, train_spans: int = TRAIN_SPANS) -> Model:
    """Label model over all candidates, span classifier on a bounded sample of them."""
    each = cands.select("doc_id", F.explode("cands").alias("c")).select("doc_id", "c.*")
    patterns = each.groupBy("kind", "votes").count().collect()      # kinds * 3**5 at most
    labels = LabelModel(5).fit([list(r["votes"]) for r in patterns],
                               [r["count"] for r in patterns], [r["kind"] for r in patterns])
    h = F.xxhash64("doc_id", "start", "kind")
    # one row per candidate: copies of a text, with one id in redact(), tie in their hashes
    few = least_hashed(each.distinct(), h, train_spans, sum(r["count"] for r in patterns))
    sample = (few.orderBy(h, "start", "end")
              .limit(train_spans).select("kind", "votes", "features").collect())
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for i, r in enumerate(sample):
        np.add.at(x[i], r["features"], 1.0)
    y = labels.posterior(np.array([r["votes"] for r in sample]).reshape(-1, 5),
                         [r["kind"] for r in sample])
    weights, bias = fit_logistic(x, y)
    return Model(labels, weights, bias)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         train_spans: int = TRAIN_SPANS, gazetteer: dict = GAZETTEER) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans``; the last two are
    arrays of ``kind:start:end`` by kind as listed, then start."""
    cands = candidates(docs, id_col, text_col, gazetteer)
    model = fit(cands, train_spans)
    kind = cands.schema["doc_id"].dataType.simpleString()
    order = {k: i for i, k in enumerate(KINDS)}

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, every = [[] for _ in range(5)], [], []
        for cs in b.column("cands").to_pylist():
            kept = sorted((order[c["kind"]], c["start"], c["end"]) for c in cs
                          if model.keeps(c["kind"], c["features"]))
            for i in range(4):
                counts[i].append(sum(k == i for k, _, _ in kept))
            counts[4].append(sum(k >= 4 for k, _, _ in kept))
            base.append([f"{KINDS[k]}:{s}:{e}" for k, s, e in kept if k < 4])
            every.append([f"{KINDS[k]}:{s}:{e}" for k, s, e in kept])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
             pa.array(base, pa.list_(pa.string())), pa.array(every, pa.list_(pa.string()))],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "spans"])

    return run_arrow(cands, rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, "
                     "n_phone long, n_added long, base_spans array<string>, spans array<string>")


def _masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span replaced by its kind; overlapping spans are replaced as one."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= at:
            out.append(text[at:start] + f"<{kind.upper()}>")
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", train_spans: int = TRAIN_SPANS,
           chars_col: str | None = None, gazetteer: dict = GAZETTEER) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; null texts stay null.
    ``chars_col``, if given, is set to the new length. Overlapping spans are replaced as one.

    Texts are scanned once: the rows are written with their candidates, the model is fitted on
    these, and the spans that it keeps are cut out of the rows read back."""
    schema = docs.schema
    # two columns of our own, named unlike any of the input's
    name = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    key, cands = f"{name}key", f"{name}cands"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    at = docs.columns.index(text_col)

    def scanned(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*b.columns, _column(b.column(at).to_pylist(), gazetteer)], [*b.schema.names, cands])

    keyed = docs.withColumn(key, F.xxhash64(text_col))
    rows = written(run_arrow(keyed, scanned, f"{kinds}, `{key}` long, `{cands}` {_CANDS}"))
    model = fit(rows.select(F.col(key).alias("doc_id"), F.col(cands).alias("cands")), train_spans)

    def masked(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index(cands)
        texts = [_masked(t, [(c["start"], c["end"], c["kind"]) for c in found
                             if model.keeps(c["kind"], c["features"])])
                 for t, found in zip(b.column(at).to_pylist(), b.column(i).to_pylist())]
        columns = [pa.array(texts, b.schema.field(at).type) if j == at else c
                   for j, c in enumerate(b.columns[:i])]
        return pa.RecordBatch.from_arrays(columns, b.schema.names[:i])

    out = run_arrow(rows.drop(key), masked, kinds)
    return out if chars_col is None else out.withColumn(
        chars_col, F.length(text_col).cast(schema[chars_col].dataType))
