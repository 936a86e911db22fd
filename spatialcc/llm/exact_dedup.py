"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keeps, in a RocksDB state store without expiry, for every content digest how often
it was seen and the stable identifier and content locator of the row that stays. Hits (digests seen more than once)
are then checked on their full bytes, so that a digest collision can't merge two texts; of texts of earlier runs the
bytes are read at the locator. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialcc.llm.common import BLANKS, content_digest, fresh, land, names_in, sized, text_or_empty, work_dir

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of a stopped query are closed at the next one
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, BLANKS, " ")


def _rank() -> Column:
    """What orders the rows of one text: the first run, in it the smallest doc_id, null ids last, then the row."""
    return F.struct("run", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "locator")


def update_state(spark: SparkSession, arrivals: str, schema, checkpoint: str) -> DataFrame:
    """Run the stream over all files below `arrivals` that it hasn't seen and return the state: digest, n, keeper.

    With the same checkpoint, a later call takes only the files that have come since; the state never expires. Its
    settings hold for a session of the stream's own.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in _STATE.items():
        own.conf.set(key, value)
    seen = own.readStream.schema(schema).option("maxFilesPerTrigger", 100_000).parquet(f"{arrivals}/*")
    state = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("keeper"))
    state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(checkpoint)
    n, keeper = kept.schema["value"].dataType.names
    return kept.select(F.col("key")["digest"].alias("digest"), F.col("value")[n].alias("n"), F.col("value")[keeper].alias("keeper"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_digest, state_dir: str | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are identical after replacing each run of ASCII white space by one space; null counts as
    empty, and empty texts equal each other. Of equal texts the row with the smallest doc_id stays; null ids come
    last. Of rows that repeat an id and its text exactly one stays. An empty table gives an empty result; extra columns
    are ignored. `digest` is applied to the normalised text; collisions are found by comparing full texts.

    state_dir is a folder that all machines share and that keeps the stream's state between runs. Rows of earlier runs
    then count as seen: a text stays where it came first, group_size counts all runs so far, and the result has the rows
    of this run. The folder keeps one copy of each distinct text, to which the state's locators point. One run uses the
    folder at a time. Its state has as many partitions as spark.sql.shuffle.partitions says at the first run.
    """
    spark = docs.sparkSession
    root = state_dir.rstrip("/") if state_dir else work_dir(spark, "dedup")
    run = max((int(x) for x in names_in(spark, f"{root}/arrivals")), default=-1) + 1
    source = docs.select(F.col(doc_id).alias("doc_id"), normalised(text_or_empty(text)).alias("text")).withColumn("digest", digest(F.col("text")))
    arriving = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.lit(run).alias("run"),
        F.monotonically_increasing_id().alias("row"),
        digest(normalised(text_or_empty(text))).alias("digest"),
        F.lit(f"content/{run}").alias("locator") if state_dir else F.input_file_name().alias("locator"),
    )
    arrived = land(arriving, f"{root}/arrivals/{run}")
    state = land(update_state(spark, f"{root}/arrivals", arrived.schema, f"{root}/state"), work_dir(spark, "state"))
    if run:  # of the state only what this run has brought
        state = state.join(arrived.select("digest").distinct(), "digest", "left_semi")

    hits = sized(state.filter("n > 1").select("digest"))
    texts = source.select("digest", "text").join(hits, "digest", "left_semi")
    earlier = state.filter(F.col("keeper.run") < run)
    for place in earlier.select("keeper.locator").distinct().collect() if run else []:  # one folder for each earlier run at most
        texts = texts.unionByName(spark.read.schema(_CONTENT).parquet(f"{root}/{place[0]}").join(earlier, "digest", "left_semi"))
    # min = max over full texts says that all texts of a digest are the same bytes; it is combined before the shuffle.
    several = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")
    known = [f"{root}/collided/{x}" for x in names_in(spark, f"{root}/collided")]
    if known:  # digests that stood for several texts before
        several = several.union(spark.read.schema(_known(arrived)).parquet(*known).select("digest").join(state, "digest", "left_semi")).distinct()
    collided = land(several, work_dir(spark, "collided"))
    odd = not collided.isEmpty()
    if state_dir:
        new = state.filter(F.col("keeper.run") == run).select(F.col("digest").alias("_digest"), F.col("keeper.doc_id").alias("_id"))
        new = new.join(collided, F.col("_digest") == F.col("digest"), "left_anti") if odd else new
        first = source.join(sized(new), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        first.select("digest", "text").write.parquet(f"{root}/content/{run}")
    found = arrived.join(state, "digest").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("run") == F.col("keeper.run")) & (F.col("row") == F.col("keeper.row"))).alias("kept"), "digest"
    )
    if not odd:
        return found
    return found.join(collided, "digest", "left_anti").unionByName(_by_text(source, arrived, state, collided, known, root, run, bool(state_dir)))


_CONTENT = "digest binary, text string"


def _known(arrived: DataFrame) -> str:
    """The schema of what is kept on texts whose digest is another text's, too."""
    kind = arrived.schema["doc_id"].dataType.simpleString()
    return f"digest binary, text string, n bigint, keeper struct<run:int,unnamed:boolean,doc_id:{kind},row:bigint,locator:string>, run int"


def _by_text(source: DataFrame, arrived: DataFrame, state: DataFrame, collided: DataFrame, known: list[str], root: str, run: int, keep: bool) -> DataFrame:
    """Classes of the rows whose digest stands for several texts, by the texts themselves."""
    spark = source.sparkSession
    rows = source.join(collided, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = land(rows.withColumn("run", F.lit(run)).withColumn("locator", F.lit(f"collided/{run}")), work_dir(spark, "by-text"))
    classes = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("keeper"))
    if run:
        before = spark.createDataFrame([], _known(arrived))
        if known:  # counts so far, of the latest run that brought the digest
            log = spark.read.schema(_known(arrived)).parquet(*known).join(collided, "digest", "left_semi")
            before = log.join(log.groupBy("digest").agg(F.max("run").alias("run")), ["digest", "run"], "left_semi")
        # A digest that stood for one text until now: its text is at the locator, and all earlier rows had it.
        here = arrived.join(collided, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("here"))
        plain = state.filter(F.col("keeper.run") < run).join(here, "digest").join(before.select("digest").distinct(), "digest", "left_anti")
        plain = land(plain.select("digest", (F.col("n") - F.col("here")).alias("n"), "keeper"), work_dir(spark, "plain"))
        classes = classes.unionByName(before.select("digest", "text", "n", "keeper"))
        for place in plain.select("keeper.locator").distinct().collect():
            held = spark.read.schema(_CONTENT).parquet(f"{root}/{place[0]}").dropDuplicates(["digest"])
            classes = classes.unionByName(held.join(plain.filter(F.col("keeper.locator") == place[0]), "digest").select("digest", "text", "n", "keeper"))
        classes = classes.groupBy("digest", "text").agg(F.sum("n").alias("n"), F.min("keeper").alias("keeper"))
    classes = land(classes.withColumn("run", F.lit(run)), f"{root}/collided/{run}" if keep else work_dir(spark, "classes"))
    return rows.drop("run").join(classes, ["digest", "text"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("keeper.run") == run) & (F.col("row") == F.col("keeper.row"))).alias("kept"), "digest"
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows that repeat an id together with its text are the same row; one of them stays. Rows are told apart by id and
    digest, so texts are shuffled only if neither the dropped nor the repeated rows are few enough to be broadcast.
    """
    spark = docs.sparkSession
    found = land(exact_duplicates(docs, doc_id, text).select("doc_id", "digest", "kept"), work_dir(spark, "kept"))
    keys = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    odd = land(keys.filter("n > 1 or not kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "kept"), work_dir(spark, "odd"))
    own = fresh(docs, "_own")
    marked = docs.withColumn(own, content_digest(normalised(text_or_empty(text))))
    same = lambda keys: marked[doc_id].eqNullSafe(keys["_id"]) & (marked[own] == keys["_digest"])
    plain = marked.join(keys := sized(odd.select("_id", "_digest")), same(keys), "left_anti")
    again = odd.filter("kept").select("_id", "_digest")
    if not again.isEmpty():
        rows = marked.join(keys := sized(again), same(keys), "left_semi")
        first = rows.groupBy(rows[doc_id].alias("_id"), rows[own].alias("_digest")).agg(F.first(F.struct(*docs.columns)).alias("_row"))
        plain = plain.select(*docs.columns).unionByName(first.select("_row.*"))
    return plain.select(*docs.columns)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def oracle() -> str:
    """DuckDB SQL of the query."""
    return r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
