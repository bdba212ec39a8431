"""Secret scans by corpus-wide ownership frequency.

Spans that look like secrets are found in every text, and their values are hashed and counted
over the corpus by distinct repositories and owners. A value that several owners hold is an
example that people copy; one that a single owner or two hold, and that looks random, is
taken for a live credential. Base spans (assignments, access keys, long hex) are always
reported; bare tokens are added where the corpus shows them to be owner-specific.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch, same, text_key

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Bare tokens: candidates that only their ownership can tell from identifiers.
BARE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
NUMBERS = ("n_live", "n_copied", "most_owners", "most_repos")
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _spans(text: Column, pattern: str, kind: str, group: int, hint: Column) -> Column:
    """Spans of all matches, left to right, as structs of start, kind, end (exclusive), value.

    Texts between matches and the matches themselves take turns, which gives the positions.
    """
    parts = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(parts.alias("gap"), whole.alias("len"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + m["len"]).alias("end"),
                        m["value"].alias("value"))
        # the part after the last match has no match of its own
        return F.when(m["len"].isNull(), acc).otherwise(
            F.struct((begin + m["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(hint, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidate_spans(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row per input row: doc_id, tkey, repo, owner, base spans and bare tokens beside them."""
    rows = docs.select("doc_id", text_key().alias("tkey"), repo.alias("repo"), owner.alias("owner"),
                       F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("assign", _spans(text, ASSIGN, "assign", 2, text.rlike(ASSIGN)))
    rows = rows.withColumn("access", _spans(text, ACCESS, "access", 0, text.contains("AKIA")))
    rows = rows.withColumn("hex", _spans(text, HEX, "hex", 0, text.rlike(HEX)))
    rows = rows.withColumn("bare", _spans(text, BARE, "owned", 0, text.rlike(BARE)))
    assign = F.filter("assign", lambda s: F.char_length(s["value"]) >= 6)
    rows = rows.withColumn("base", F.array_sort(F.concat(assign, "access", "hex")))

    def beside(s: Column) -> Column:
        looks = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        return looks & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return rows.select("doc_id", "tkey", "repo", "owner", "base", F.filter("bare", beside).alias("bare"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_sha256, n_repos, n_owners): a value's distinct pairs first, then counts of them."""
    values = candidates.select("repo", "owner", F.explode(F.concat("base", "bare")).alias("s"))
    pairs = values.select(F.sha2("s.value", 256).alias("value_sha256"), "repo", "owner").distinct()
    # one row per value and repository, then per value and owner: no distinct aggregate expands rows
    repos = pairs.groupBy("value_sha256", "repo").agg(F.min("owner").alias("owner")).groupBy("value_sha256").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = pairs.groupBy("value_sha256", "owner").agg(F.min("repo").alias("repo")).groupBy("value_sha256").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "value_sha256")


def scan_secrets(docs: DataFrame, repo: Column | None = None, owner: Column | None = None,
                 max_owners: int = 2, max_repos: int = 4, min_distinct: int = 10) -> tuple[DataFrame, DataFrame]:
    """(findings, rows).

    ``findings``: one row per candidate span: doc_id, tkey, kind, start, end (code points), value,
    n_repos, n_owners, verdict (``live`` or ``copied``), reported. ``rows``: one per input row: doc_id,
    base and spans as lists of (start, kind, end), and of all its candidates n_live, n_copied, most_owners
    and most_repos. A repository is a source's texts of one language
    and an owner a source, unless columns are given; null is a repository or owner of its
    own. A null text is empty. Rows that repeat a doc_id are scanned each by itself; equal ones have
    equal results. A bare token is reported when at most ``max_owners`` owners hold it and it has
    ``min_distinct`` different characters. Empty tables give none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    repo = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    rows = scratch.keep(candidate_spans(docs, repo, owner))
    shared = scratch.keep(ownership(rows))
    spans = rows.filter(F.size("base") + F.size("bare") > 0).select(
        "doc_id", "tkey", F.explode(F.concat("base", "bare")).alias("s")).withColumn("value_sha256", F.sha2("s.value", 256))
    # a value that a third of all rows hold is a hot key of this join, which adaptive execution splits
    spans = spans.join(shared, "value_sha256")
    varied = F.size(F.array_distinct(F.split("s.value", ""))) >= min_distinct
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & varied
    kinds = F.array(*[F.lit(k) for k in KINDS])
    findings = spans.select(
        "doc_id", "tkey", F.get(kinds, F.col("s.kind")).alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.col("s.value").alias("value"), "n_repos", "n_owners", F.when(live, "live").otherwise("copied").alias("verdict"),
        (live | (F.col("s.kind") < 3)).alias("reported"))
    place = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    # equal rows find the same spans: a set holds each once
    seen = spans.groupBy("doc_id", "tkey").agg(
        F.collect_set(F.when((F.col("s.kind") == 3) & live, place)).alias("added"), F.size(F.collect_set(F.when(live, place))).alias("n_live"),
        F.size(F.collect_set(F.when(~live, place))).alias("n_copied"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    places = F.transform("l.base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    numbers = [F.coalesce(f"r.{c}", F.lit(0)).cast("bigint").alias(c) for c in NUMBERS]
    out = rows.alias("l").join(seen.alias("r"), same("l", "r", "doc_id", "tkey"), "left").select(
        "l.doc_id", places.alias("base"), F.array_sort(F.concat(places, F.coalesce("r.added", none))).alias("spans"), *numbers)
    return findings, out


def shown(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def _of_kind(kind: int) -> Callable[[Column], Column]:
    # a function of one argument: a second one would be the place in the list
    return lambda span: span["kind"] == kind


def digest(rows: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"), *NUMBERS)
