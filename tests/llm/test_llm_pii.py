"""Operator 10 against the fixed patterns as plain regular expressions."""
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from llm_data import frame, odd_docs
from rewardlake.llm import common, pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def reference(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d)
                    or kind == "phone" and 9 <= len(d) <= 15):
                out[kind].append(m.span())
    return out


def joined(text):
    return ",".join(f"{k}:{a}:{b}" for k, s in reference(text).items() for a, b in s)


def test_base_spans():
    rng = random.Random(3)
    pool = ["4111 1111 1111 1111", "4111-1111-1111-1111", "a@b.c", "@", "1.2.3.4", "255.256.1.1",
            "+1 (234) 567-8901", "..", " x ", "é"]
    for _ in range(8000):
        t = "".join(rng.choice("0123456789.+-() @a") if rng.random() < .8 else rng.choice(pool)
                    for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == reference(t), t


def test_long_runs_take_linear_time():
    begin = time.time()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000,
              "(123) " * 30_000, "AB12 " * 40_000, "a (at) " * 20_000):
        pii.candidates_of(t)
    assert time.time() - begin < 30


def plain_candidates(text):
    """Wider matches kept one by one if they overlap none of those kept before."""
    kept = [(k, a, b) for k in pii.BASE for a, b in pii.base_spans(text)[k]]
    wide = pii._wide(text)
    for kind in pii.FIRST:
        for a, b in wide[kind]:
            if not any(x < b and a < y for _, x, y in kept):
                kept.append((kind, a, b))
    return kept


def test_many_accepted_spans_take_linear_time():
    for part in ("Mr John Smith, ", "a@b.co ", "123-45-6789; ", "joe (at) b (dot) com, "):
        text = part * 50_000
        begin = time.time()
        assert len(pii.candidates_of(text)) == 50_000
        assert time.time() - begin < 5, part


def test_overlapping_candidates_equal_plain_choice():
    rng = random.Random(6)
    pool = ["Mr John Smith", "123-45-6789", "(030) 555-1234", "a@b.co", "joe (at) b.com", "AB12 3456 7890",
            "4111 1111 1111 1111", "+49 30 123456", "1.2.3.4", " ", "-", "12", "Dr ", "Anna", "."]
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [(c.kind, c.start, c.end) for c in pii.candidates_of(t)] == plain_candidates(t), t


def test_gazetteer_is_a_parameter():
    text = "ask Mr Zork"
    vote = lambda g: pii.candidates_of(text, g)[0].votes[2]         # noqa: E731
    assert vote(pii.GAZETTEER) == 0
    assert vote({**pii.GAZETTEER, "given_name": frozenset({"zork"})}) == 1


def test_redaction_equals_found_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("_key", F.lit(1)).withColumn("_cands", F.lit("x"))
    # the same samples for both: the text's hash is the id
    found = pii.find(docs.withColumn("doc_id", F.xxhash64("text"))).select("doc_id", "spans")
    spans = {r.doc_id: r.spans for r in found.collect()}
    text = {r.doc_id: (r.h, r.text) for r in docs.select(
        "doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    got = pii.redact(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        h, t = text[r.doc_id]
        parts = [s.split(":") for s in spans[h]]
        assert r.text == pii._masked(t, [(int(a), int(b), k) for k, a, b in parts])


def test_find_on_odd_documents(spark):
    rows = odd_docs() + [(70, "mail é a.b@c.de, ip 10.0.0.7", "de", "s", 0),
                         (71, "4111 1111 1111 1111 and +49 30 1234567", None, None, None)]
    got = pii.find(frame(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), ",".join(r.base_spans)) for r in got) == sorted(
        (str(d), joined(t or "")) for d, t, *_ in rows)
    assert pii.find(frame(spark, [])).count() == 0


def test_wide_candidates_and_redaction(spark):
    text = ("write to jane (at) mail (dot) com or call (030) 555-1234, ssn 123-45-6789, "
            "iban DE89 3704 0044 0532 0130 00, mail é x@y.org")
    rows = [(1, text, "en", "s", len(text)), (2, None, None, None, None), (3, "", "en", "s", 0),
            (4, "order 1234567890123 of 2020", "en", "s", 0)]
    docs = frame(spark, rows, extra=True)
    out = {r.doc_id: r for r in pii.redact(docs, chars_col="n_chars").collect()}
    assert docs.columns == pii.redact(docs).columns
    assert out[1].text == ("write to <WRITTEN_EMAIL> or call <LOCAL_PHONE>, ssn <IDENTITY>, "
                           "iban <IBAN>, mail é <EMAIL>")
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and out[4].text == rows[3][1]


def test_reliabilities_follow_agreement():
    from rewardlake.llm.weak import LabelModel
    rng = random.Random(0)
    votes, counts = [], []
    for _ in range(2000):
        y = rng.choice((-1, 1))
        votes.append([y if rng.random() < a else -y for a in (0.95, 0.9, 0.6)])
        counts.append(1)
    m = LabelModel(3).fit(votes, counts, [""] * len(votes))
    assert abs(m.accuracy[0] - 0.95) < 0.04 and abs(m.accuracy[2] - 0.6) < 0.06


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_pii_weak_supervision(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ref = reference(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in ref.values()]
        assert r.base_sha256 == hashlib.sha256(joined(text[r.doc_id]).encode()).hexdigest()
        assert set(joined(text[r.doc_id]).split(",")) <= set(r.spans.split(","))


def test_samples_are_cut_before_they_are_ordered(spark):
    table = spark.range(0, 50_000, 1, 16).withColumn("h", F.xxhash64("id"))
    few = common.least_hashed(table, F.col("h"), 500, 50_000)
    assert 500 <= few.count() < 2_000
    first = lambda df: [r.id for r in df.orderBy("h").limit(500).collect()]        # noqa: E731
    assert first(few) == first(table)
    assert common.least_hashed(table, F.col("h"), 50_000, 50_000).count() == 50_000
    tied = table.withColumn("h", F.lit(2 ** 62))
    assert common.least_hashed(tied, F.col("h"), 500, 50_000).count() == 50_000


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    real = pii.fit_logistic
    monkeypatch.setattr(pii, "fit_logistic", lambda x, y: seen.append(x) or real(x, y))
    rows = [(i, f"write to user{i}@site{i % 7}.org", "en", "s", 0) for i in range(40)]
    for copies in (1, 6):
        pii.redact(frame(spark, rows * copies), train_spans=30)
    assert len(seen[0]) == len(seen[1]) == 30 and (seen[0] == seen[1]).all()


def test_written_addresses_in_any_case():
    for at in ("(at)", "[At]", "(aT)", "[AT]"):
        text = f"write to joe {at} example (dot) com"
        assert [(c.kind, text[c.start:c.end]) for c in pii.candidates_of(text)] == [
            ("written_email", f"joe {at} example (dot) com")]
