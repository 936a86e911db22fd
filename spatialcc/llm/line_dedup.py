"""Removal of lines that spread over many sites.

HyperLogLog sketches of the sites of each line merge by aggregation; lines whose estimate is near the threshold get an
exact distinct count; lines on enough sites are boilerplate and are removed. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spatialcc.llm.common import fresh, land, sized, text_or_empty, work_dir

#: A line on at least this many sites is boilerplate.
MIN_SITES = 6
#: Log2 of a sketch's registers: a standard error of 1.6 %.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold get an exact count; about 15 standard errors.
NEAR = 0.25
#: Different bad lines (about 35 bytes each) up to which every task looks lines up in a table of them; beyond, texts are shuffled by id.
BROADCAST_LINES = 100_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def line_hash(line: Column) -> Column:
    """128 bits of a line's SHA-256 would be wide; two independent 64- and 32-bit hashes tell lines apart."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _lines(text: Column) -> Column:
    """The lines that can be boilerplate: those with something in them, as keys."""
    return F.filter(F.transform(F.split(text, "\n"), line_key), lambda x: x != "")


def line_sites(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_id, site, lines): the site and the distinct lines (hashes) of each row, written once, so that texts are split once."""
    lines = F.array_distinct(F.transform(_lines(text_or_empty(text)), line_hash))
    return land(docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("site"), lines.alias("lines")), work_dir(docs.sparkSession, "lines"))


def spread_lines(held: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (hashes) on at least min_sites sites, with the estimated and, near the threshold, the exact count; `held`: line_sites()."""
    spark = held.sparkSession
    sites = held.select("site", F.explode("lines").alias("line"))
    # A line on n sites is in n documents at least: most lines go before any sketch is made.
    often = land(sites.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("line"), work_dir(spark, "often"))
    seen = sites.join(sized(often), "line", "left_semi")
    sketches = seen.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    estimated = land(sketches.select("line", F.hll_sketch_estimate("sketch").alias("estimate")), work_dir(spark, "spread"))
    near = estimated.filter(F.col("estimate").between(int(min_sites * (1 - NEAR)), int(min_sites * (1 + NEAR)) + 1)).select("line")
    exact = seen.join(sized(near), "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("exact"))
    return estimated.join(exact, "line", "left").filter(F.coalesce("exact", "estimate") >= min_sites)


def among(spread: list[Row]) -> Callable[[Column], Column]:
    """Whether a line's hash is one of those collected, as a look-up in a constant table of hash buckets."""
    n = 2 * len(spread) + 1
    buckets = [""] * n
    for (line,) in spread:
        buckets[line.a % n] += f",{line.a}:{line.b},"
    table = F.split(F.lit("|".join(buckets)), r"\|")  # folded once to an array

    def found(line: Column) -> Column:
        a, b = F.xxhash64(line), F.hash(line)
        return F.contains(F.get(table, F.pmod(a, F.lit(n)).cast("int")), F.concat(F.lit(","), a.cast("string"), F.lit(":"), b.cast("string"), F.lit(",")))

    return found


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs` with boilerplate lines taken from their texts, and n_lines and n_removed.

    A line is what stands between line feeds; lines are compared without white space at their ends, and blank lines
    are never removed. Sites are the values of `source`; null is one site. Null texts become empty. Rows that repeat
    an id are all cleaned. If every line goes, the text is empty. Extra columns stay; n_lines and n_removed are replaced.
    """
    spark = docs.sparkSession
    lined = line_sites(docs, doc_id, text, source)
    spread = land(spread_lines(lined, min_sites).select("line"), work_dir(spark, "boilerplate"))
    key, bad, left = fresh(docs, "_id"), fresh(docs, "_bad"), fresh(docs, "_left")
    lines = F.split(text_or_empty(text), "\n")
    if spread.count() <= BROADCAST_LINES:
        # What each task gets is bounded by the number of different bad lines, not by the documents that hold them.
        is_bad = among(spread.collect())
        both, kept = docs, F.filter(lines, lambda x: ~is_bad(line_key(x)))
    else:
        held = lined.select("_id", F.explode("lines").alias("line")).join(spread, "line", "left_semi")
        held = land(held.groupBy("_id").agg(F.collect_set("line").alias("_bad")), work_dir(spark, "held"))
        held = held.select(F.col("_id").alias(key), F.col("_bad").alias(bad))
        both = docs.join(held, docs[doc_id].eqNullSafe(held[key]), "left")
        kept = F.when(F.col(bad).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(bad, line_hash(line_key(x)))))
    return (
        both.withColumn("n_lines", F.size(lines).cast("bigint"))
        .withColumn(left, kept)
        .withColumn("n_removed", F.col("n_lines") - F.size(left))
        .withColumn(text, F.array_join(left, "\n"))
        .drop(key, bad, left)
    )


def oracle() -> str:
    """DuckDB SQL of the query."""
    return rf"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(bad.key) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS text_sha256
FROM k LEFT JOIN bad USING (key) GROUP BY doc_id
"""
