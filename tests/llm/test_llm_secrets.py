"""Operator 6 against Python patterns, and its native plan."""
import hashlib
import random
import re

from llm_data import DOC_SCHEMA, frame, odd_docs
from rewardlake.llm import queries, secret_scan

ASSIGN = re.compile(
    r"(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|"
    r"(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
            if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def random_text(seed):
    rng = random.Random(seed)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", " = ", ":", "=", '"', "'", " ",
             "abcdefgh", "x1", "é", "😀", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2,
             "deadbeef", "Z9/+", "\n", "--", "K"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_base_spans_equal_python(spark):
    rows = [(i, random_text(i), None, f"s{i % 5}", None) for i in range(800)]
    rows += [(9000 + i, t, s, src, n) for i, (_, t, s, src, n) in enumerate(odd_docs())]
    text = {r[0]: r[1] or "" for r in rows}
    got = secret_scan.scan(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(text[r.doc_id])
        assert r.base_spans == ",".join(want), text[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_ownership_separates_examples_from_live_values(spark):
    live, copied = "Zk9" + "q7Xw2Lm4Vb8Nc1Rt6Yp", "Aj3" + "k5Dz0Hs7Fg2Qe9Wo4Ui"
    rows = [(1, f"use {live} here", "en", "a", 0), (2, f"and {live} too", "en", "a", 0)]
    rows += [(10 + i, f"see {copied} or token = '{copied}'", "en", f"o{i}", 0) for i in range(4)]
    rows += [(50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "en", "b", 0),
             (51, "token = 'changeme-example-1234'", "en", "b", 0)]
    got = {r.doc_id: r for r in secret_scan.scan(
        spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got[1].spans == f"live:4:{4 + len(live)}" and got[1].n_live == 1
    for i in range(10, 14):
        assert got[i].n_copied == 2 and "live" not in got[i].spans and got[i].n_assign == 1
    assert got[50].spans == "" and got[51].n_live == 0 and got[51].n_assign == 1
    f = [x for x in got[1].findings]
    assert f[0].n_repos == 2 and f[0].n_owners == 1


BARE = re.compile("[A-Za-z0-9+/_=-]{20,}")
DULL = re.compile("(?i)example|sample|dummy|placeholder|changeme|x{6,}|0123456789|abcdefgh")


def plain_scan(rows, max_owners, max_repos):
    """All candidates of all rows, then the counts, then who stays."""
    found = []
    for i, (_, text, owner, repo) in enumerate(rows):
        spans = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text)
                  if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text)
                  if len(m[0]) >= 32]
        for m in BARE.finditer(text):
            if (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
                    and not any(s < m.end() and m.start() < e for s, _, e, _ in spans[:])):
                spans.append((m.start(), 3, m.end(), m[0]))
        base_only = [s for s in spans if s[1] < 3]
        spans = [s for s in spans if s[1] < 3 or not any(
            b[0] < s[2] and s[0] < b[2] for b in base_only)]
        found += [(i, *s) for s in spans]
    owners, repos = {}, {}
    for i, _, _, _, v in found:
        owners.setdefault(v, set()).add(rows[i][2])
        repos.setdefault(v, set()).add((rows[i][2], rows[i][3]))
    out = [[] for _ in rows]
    for i, s, k, e, v in sorted(found, key=lambda f: f[:3]):
        copied = len(owners[v]) > max_owners or len(repos[v]) > max_repos
        live = (not copied and len(set(v)) >= 10 and re.search("[0-9]", v)
                and re.search("[A-Za-z]", v) and not DULL.search(v))
        if k < 3 or live:
            out[i].append(f"{('assign', 'access', 'hex', 'live')[k]}:{s}:{e}")
    return [",".join(o) for o in out]


def test_added_spans_equal_plain_scan(spark):
    rng = random.Random(12)
    values = ["".join(rng.choice("abXY019+/_") for _ in range(rng.randint(18, 30)))
              + "Qw7" for _ in range(12)]
    rows = []
    for i in range(400):
        parts = [rng.choice([rng.choice(values[:9]), values[9 + i % 3] if i % 50 == 0 else " ",
                             "token = '" + rng.choice(values) + "'", "AKIA" + "B7" * 8, "é ",
                             "deadbeef" * 4, " ", "apikey:", "changeme" * 3 + "1"])
                 for _ in range(rng.randint(0, 8))]
        # a third of the rows of one owner
        rows.append((i, " ".join(parts) if i % 2 else "".join(parts),
                     "hot" if i % 3 == 0 else f"o{i % 4}", f"r{i % 40}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    for limits in ((2, 20), (1, 3), (50, 400), (5, 9)):
        got = secret_scan.scan(df, repo_col="repo", max_owners=limits[0], max_repos=limits[1])
        assert [r.spans for r in sorted(got.collect(), key=lambda r: r.doc_id)] == plain_scan(
            rows, *limits)


def test_repositories_count_besides_owners(spark):
    value = "Zk9q7Xw2Lm4Vb8Nc1Rt6Yp"
    for repos, live in ((3, 1), (secret_scan.MAX_REPOS, 1), (secret_scan.MAX_REPOS + 1, 0)):
        rows = [(i, f"use {value} here", "en", "one owner", 0) for i in range(repos)]
        got = secret_scan.scan(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
        assert [r.n_live for r in got] == [live] * repos
        assert [r.n_copied for r in got] == [1 - live] * repos


def test_many_matches_in_one_text(spark):
    """50,000 spans of one text in the time of a sort."""
    import time
    text = "token=abcdefg12 " * 50_000
    rows = [(1, text, "en", "s", 0), (2, "x1Y2z3w4" * 9 + " " + "AKIAABCDEFGHIJKLMN " * 20_000, "en", "s", 0)]
    secret_scan.scan(frame(spark)).collect()                    # warm
    begin = time.time()
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert time.time() - begin < 15
    assert got[1].n_assign == 50_000 and got[2].n_access == 20_000
    assert got[1].base_spans == ",".join(base(text))


def test_empty_table_and_query(spark):
    assert secret_scan.scan(frame(spark, [])).count() == 0
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = queries.op6_secret_ownership(spark, sf)
    for r in df.collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base(text[r.doc_id])).encode()).hexdigest()
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
