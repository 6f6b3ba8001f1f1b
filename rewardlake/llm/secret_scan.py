"""Operator 6: secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns. Besides, every long
run of token characters that mixes letters and digits is a bare candidate. The value of each
candidate (of an assignment, its right side) is hashed; per hash the distinct repositories and
owners in the whole corpus are counted. A value seen with more than ``max_owners`` owners or in more
than ``max_repos`` repositories is a widely copied example; one seen with fewer, whose characters are
varied, is specific to its owner and live-looking. Bare candidates judged live that touch no base
span are added with kind ``live``.

Match positions: a pattern's matches and the stretches between them, both in order, are listed in
one pass each; running sums of their lengths, a window within the document, are the places. Whether a
bare candidate touches a base span follows from the furthest end before it and the next start after
it, two more running windows. So the time is that of a sort in the matches of a text.

Occurrences are reduced to one row per (hash, owner, repository) and then per hash with partial
aggregation before the shuffle; the join back to occurrences splits hot hashes (adaptive skew
join). Raw values never leave the first stage. Null texts count as empty; null owners and
repositories are a value of their own; repeated rows are scanned each; an empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from rewardlake.llm.common import F, text_of, written

# The base patterns, the lengths they need, and the order of kinds.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "live")

BARE = r"[A-Za-z0-9+/_=-]{20,}"
MAX_OWNERS = 2
MAX_REPOS = 20
MIN_DISTINCT = 10            # different characters of a live-looking value
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0123456789|abcdefgh"


_FOUND = "array<struct<gap:int,len:int,keep:boolean,hash:string,looks_live:boolean>>"


def _matches(text: Column, pattern: str, value, keep) -> Column:
    """The matches of ``pattern`` in order: characters since the match before, characters, whether
    ``keep`` of it holds, the hash of its ``value`` and whether that looks live."""
    def one(z: Column) -> Column:
        m = z["1"]
        v, kept = value(m), keep(m)
        varied = F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT
        looks = (varied & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(PLACEHOLDER))
        return F.struct(F.length(z["0"]).alias("gap"), F.length(m).alias("len"),
                        kept.alias("keep"), F.when(kept, F.sha2(v, 256)).alias("hash"),
                        F.when(kept, looks).alias("looks_live"))

    # zipped, so that each list is made once and not for every element
    both = F.arrays_zip(F.split(text, pattern, -1),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = F.transform(F.filter(both, lambda z: z["1"].isNotNull()), one)
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(_FOUND)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``row, doc_id, owner, repo, found``: every document with its matches by kind; written."""
    src = docs.select(F.col(id_col).alias("doc_id"),
                      F.col(owner_col).cast("string").alias("owner"),
                      F.col(repo_col).cast("string").alias("repo"), text_of(text_col).alias("text"))
    text = F.col("text")

    def right(m: Column) -> Column:
        return F.regexp_extract(m, ASSIGN, 2)

    def itself(m: Column) -> Column:
        return m

    def always(m: Column) -> Column:
        return F.lit(True)

    found = F.create_map(
        F.lit("assign"), _matches(text, ASSIGN, right, lambda m: F.length(right(m)) >= ASSIGN_VALUE),
        F.lit("access"), _matches(text, ACCESS, itself, always),
        F.lit("hex"), _matches(text, HEX, itself, always),
        F.lit("live"), _matches(text, BARE, itself,
                                lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")))
    return written(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner",
                              "repo", found.alias("found")))


def candidates(rows: DataFrame) -> DataFrame:
    """``row, owner, repo, kind, start, end, hash, looks_live``: the base spans of :func:`scanned`
    rows, and the bare candidates (kind ``live``) that touch none; code points, end exclusive;
    written."""
    each = (rows.select("row", "owner", "repo", F.explode("found").alias("kind", "of_kind"))
            .select("row", "owner", "repo", "kind", F.posexplode("of_kind").alias("at", "m"))
            .select("row", "owner", "repo", "kind", "at", "m.*"))
    so_far = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    spans = (each.withColumn("end", end.cast("int"))
             .withColumn("start", F.col("end") - F.col("len")).where("keep"))
    bare = F.col("kind") == "live"
    before = Window.partitionBy("row").orderBy("start", bare.cast("int"), "end")
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"))
    touched = spans.withColumns({
        "last_end": F.max(F.when(~bare, F.col("end"))).over(before),
        "next_start": F.min(F.when(~bare, F.col("start"))).over(after)})
    free = (F.coalesce(F.col("last_end") <= F.col("start"), F.lit(True))
            & F.coalesce(F.col("next_start") >= F.col("end"), F.lit(True)))
    return written(touched.where(~bare | free).select(
        "row", "owner", "repo", "kind", "start", "end", "hash", "looks_live"))


def ownership(cands: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners, n_seen`` of every candidate value in the corpus."""
    pairs = cands.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"),
                                      F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))


def findings(cands: DataFrame, max_owners: int = MAX_OWNERS,
             max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per candidate: ``row, kind, start, end, hash, n_repos, n_owners, n_seen, verdict``;
    the verdict is ``copied``, ``live`` or ``dull``."""
    verdict = (F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "copied")
               .when(F.col("looks_live"), "live").otherwise("dull"))
    return cands.drop("owner", "repo").join(ownership(cands), "hash").withColumn(
        "verdict", verdict).drop("looks_live")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         owner_col: str = "source", repo_col: str = "doc_id",
         max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_live, n_copied, base_spans, spans, findings`` per
    document; ``base_spans`` and ``spans`` are joined texts."""
    rows = scanned(docs, id_col, text_col, owner_col, repo_col)
    found = findings(candidates(rows), max_owners, max_repos).groupBy("row").agg(F.collect_list(F.struct(
        "kind", "start", "end", "hash", "n_repos", "n_owners", "verdict")).alias("findings"))
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,hash:string,"
                  "n_repos:bigint,n_owners:bigint,verdict:string>>)")
    full = (rows.select("row", "doc_id").join(found, "row", "left")
            .withColumn("findings", F.coalesce("findings", none)))
    base = F.filter("findings", lambda s: s["kind"] != "live")
    kept = F.filter("findings", lambda s: (s["kind"] != "live") | (s["verdict"] == "live"))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("findings", lambda s: s[field] == value)).cast("long")

    return full.select(
        "doc_id", *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        count("verdict", "live").alias("n_live"), count("verdict", "copied").alias("n_copied"),
        _joined(base).alias("base_spans"), _joined(kept).alias("spans"), "findings")
