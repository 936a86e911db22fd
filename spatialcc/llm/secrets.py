"""Secret scan over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. Only (blob, rule version) pairs that the ledger doesn't hold are
scanned; findings are appended to it and joined back to every row with that content. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import content_digest, exists, land, text_or_empty, visit_once, work_dir


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_KEYS = f"({_any_case('password')}|{_any_case('passwd')}|{_any_case('secret')}|{_any_case('token')}|{_any_case('api')}_?{_any_case('key')})"

# Kinds in order: pattern, group whose length counts, least length. Matches are leftmost and
# non-overlapping; those that are too short are dropped after matching.
BASE_KINDS = [
    ("assign", _KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
# What the scan adds to the base kinds.
MORE_KINDS = [
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
KINDS = BASE_KINDS + MORE_KINDS
_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def rule_version(kinds: list[tuple[str, str, int, int]]) -> str:
    """A digest of the rules; a change of any rule makes every blob unseen again."""
    return hashlib.sha256(repr(kinds).encode()).hexdigest()[:16]


def _long_enough(pattern: str, group: int, least: int) -> str:
    """A cheaper pattern that matches in every text in which the rule finds something."""
    return pattern[:-1] + f"{{{least},}}" if group == 0 and pattern.endswith("]+") and pattern.count("]") == 1 and pattern[0] == "[" else pattern


def spans_of(text: Column, kinds: list[tuple[str, str, int, int]] | None = None) -> Column:
    """All spans of a text as an array of struct<start, rank, kind, end>, by start, then kind as listed."""
    arrays = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS if kinds is None else kinds):
        if (narrowed := _long_enough(pattern, group, least)) != pattern:
            pattern, least = narrowed, 1  # a greedy run of one class: asking for its length inside the pattern is the same
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pieces = F.split(text, pattern, -1)
        arrays.append(
            F.when(text.rlike(pattern), _positions(pieces, found, counted, rank, kind, least)).otherwise(F.array().cast(f"array<{_SPAN}>"))
        )
    return F.array_sort(F.concat(*arrays))


def _positions(pieces: Column, found: Column, counted: Column, rank: int, kind: str, least: int) -> Column:
    """Spans from the pieces between matches and the matches: a start is the summed length of all before it."""
    step = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    # One pass for the ends of all matches: the running end is the last element of the growing array, 64 to a block.
    ends = F.aggregate(
        step,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("full"), F.array().cast("array<bigint>").alias("tail")),
        lambda a, x: F.struct(
            (a["at"] + x).alias("at"),
            F.when(F.size(a["tail"]) >= 256, F.concat(a["full"], F.array(a["tail"]))).otherwise(a["full"]).alias("full"),
            F.when(F.size(a["tail"]) >= 256, F.array(a["at"] + x)).otherwise(F.concat(a["tail"], F.array(a["at"] + x))).alias("tail"),
        ),
        lambda a: F.concat(F.flatten(a["full"]), a["tail"]),
    )
    each = F.arrays_zip(found.alias("m"), counted.alias("c"), F.slice(ends, F.lit(1), F.size(found)).alias("e"))
    kept = F.filter(each, lambda x: F.length(x["c"]) >= least)
    return F.transform(
        kept,
        lambda x: F.struct((x["e"] - F.length(x["m"])).cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].cast("bigint").alias("end")),
    )


def scan_secrets(docs: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text", kinds: list[tuple[str, str, int, int]] | None = None) -> DataFrame:
    """One row (doc_id, digest, spans) for each row of `docs`.

    ledger: a folder that keeps findings between runs; without one, a fresh folder is used and all blobs are unseen.
    Null texts count as empty; both have no spans. Rows with equal texts, repeated rows included, share one scan.
    Null ids are kept. An empty table gives an empty result. Extra columns are ignored.
    """
    spark, kinds = docs.sparkSession, KINDS if kinds is None else kinds
    version = rule_version(kinds)
    root = ledger or work_dir(spark, "ledger")
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    versions = land(docs.select("doc_id", content_digest(F.col("text")).alias("digest")), work_dir(spark, "versions"))
    wanted = versions.select("digest").distinct()
    schema = f"digest binary, spans array<{_SPAN}>"
    place = f"{root}/rules={version}"
    if exists(spark, place):
        wanted = wanted.join(spark.read.schema(schema).parquet(place), "digest", "left_anti")
    unseen = visit_once(docs, versions, wanted)
    found = unseen.select(content_digest(F.col("text")).alias("digest"), spans_of(F.col("text"), kinds).alias("spans")).dropDuplicates(["digest"])
    found.write.mode("append").parquet(place)
    # A run that was cut short may have been repeated. Landed, so that the join may split the rows of one digest.
    seen = spark.read.schema(schema).parquet(place).join(versions.select("digest"), "digest", "left_semi") if ledger else spark.read.schema(schema).parquet(place)
    seen = land(seen.dropDuplicates(["digest"]), work_dir(spark, "seen"))
    return versions.join(seen, "digest", "left").select("doc_id", "digest", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of scan_secrets()' rows."""
    base = [k[0] for k in BASE_KINDS]
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL of the query."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: length(c[i]) >= {least}), lambda i: {{
  's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'r': {rank}, 'k': '{kind}', 'n': length(m[i])}}) AS spans
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS c, string_split_regex(t, '{p}') AS p FROM d)"""
        )
    joined = "coalesce(array_to_string(list_transform({0}, lambda x: x.k || ':' || (x.s)::BIGINT || ':' || (x.s + x.n)::BIGINT), ','), '')"
    base = "list_filter(a, lambda x: x.k IN ('assign', 'access', 'hex'))"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.k = '{k[0]}')) AS n_{k[0]}" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
each AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, list_sort(flatten(list(spans))) AS a FROM each GROUP BY doc_id)
SELECT doc_id, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format("a")} AS spans FROM g
"""
