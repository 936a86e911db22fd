"""What the corpus operators share: work folders, size-checked broadcasts, one visit per distinct text."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of one or two narrow columns (8 to 40 bytes each) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


#: Folders of sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spatialcc-"))
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared root."""
    return f"{shared_root(spark)}/spatialcc/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The narrow table `df`, marked for broadcast if a count shows that it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def content_digest(text: Column) -> Column:
    """Binary SHA-256 of a text's UTF-8."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def visit_once(docs: DataFrame, versions: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stand for the content in `wanted`.

    versions: (doc_id, digest) of all rows, landed; wanted: (digest). Of the rows of a wanted digest the one with the
    smallest id is visited (all of them, if an id is repeated, so callers drop repeated digests); without any id, all are. Ids of the rows to
    skip, or else of the rows to visit, are broadcast if a count shows that they are few; else the rows are shuffled
    by id.
    """
    spark = docs.sparkSession
    chosen = versions.groupBy("digest").agg(F.min(doc_id).alias("_chosen")).join(wanted, "digest", "left_semi").withColumn("_wanted", F.lit(True))
    chosen = land(chosen, work_dir(spark, "chosen"))  # so that the join below has no aggregate beside it and may split a digest's rows
    marked = versions.join(chosen, "digest", "left").select(
        F.col(doc_id).alias("_id"), (F.coalesce("_wanted", F.lit(False)) & F.col(doc_id).eqNullSafe(F.col("_chosen"))).alias("_visit")
    )
    marked = land(marked, work_dir(spark, "visits"))
    counts = {row["_visit"]: row["count"] for row in marked.groupBy("_visit").count().collect()}
    visit = marked.filter("_visit").select("_id").distinct()
    others = marked.filter("not _visit").select(F.col("_id").alias("_other")).distinct()
    skip = others.join(visit, others["_other"].eqNullSafe(visit["_id"]), "left_anti").select(F.col("_other").alias("_id"))
    if counts.get(False, 0) <= BROADCAST_ROWS:
        return docs.join(F.broadcast(skip), docs[doc_id].eqNullSafe(skip["_id"]), "left_anti")
    if counts.get(True, 0) <= BROADCAST_ROWS:
        visit = F.broadcast(visit)
    return docs.join(visit, docs[doc_id].eqNullSafe(visit["_id"]), "left_semi")
