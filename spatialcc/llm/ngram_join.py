"""Similarity join of word shingle sets: a prefix join over groups.

1. A fixed-size table of how common each shingle is, is built from document counts over all texts.
2. Shingles are ordered from rare to common; two sets with Jaccard >= 0.8 share one of the first n - ceil(0.8 n) + 1.
   Equal sets become one class; classes with the same prefix and size become one group.
3. Groups that share a prefix shingle, with fitting sizes and positions, are candidates; they are expanded to their
   members and verified on the whole sets.
4. Candidates are made in two rounds, each linear in the index: first every entry of a shingle's list against the
   list's smallest member, then only what the first round's components leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import land, remove, sized, text_or_empty, work_dir
from spatialcc.llm.components import components
from spatialcc.llm.wordhash import mixed, shingle_sets

#: Words of a shingle.
SIZE = 5
#: Two sets link when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Log2 of the cells that shingles are counted in, and of the parts that the cells are dealt in: a part is counted in 8 MB.
CELL_BITS, PART_BITS = 32, 12
#: Log2 of the commonness table's entries, half a byte each: 16 MB, whatever the input.
TABLE_BITS = 25
#: Shingles that a task gathers before it sends them on.
GATHER = 1_000_000


def _pieces(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of `values`, cut at the given places, as one binary value each."""
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), data])


def commonness(docs: DataFrame) -> np.ndarray:
    """For each slot of shingle hashes the log2 of the largest document count in it, from 0 to 15, packed in half bytes.

    All shingles of all documents are counted, in cells by 32 bits of their hash. Counts only order shingles, so two
    shingles that share a cell or slot change no result; 0 says that one document at most has a shingle. Cells are dealt
    in parts that are counted one after the other, in memory that doesn't depend on the input. Where so many
    shingles are counted that every cell is full, levels count from what an even spread gives.
    """
    spark, parts = docs.sparkSession, 1 << PART_BITS
    cells, slots = 1 << (CELL_BITS - PART_BITS), 1 << (TABLE_BITS - PART_BITS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            cuts = np.searchsorted(values, np.arange(parts + 1, dtype=np.uint64) << np.uint64(CELL_BITS - PART_BITS))
            # Ascending cells: their upper bits are runs of equal bytes, as are most counts, and take hardly any room.
            low, high = (values & np.uint32(0xFFFF)).astype(np.uint16), ((values & np.uint32(cells - 1)) >> np.uint32(16)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), _pieces(low, cuts), _pieces(high, cuts), _pieces(counts.astype(np.uint32), cuts)], ["part", "low", "high", "counts"])

        sets, size = [], 0
        for batch in batches:
            for one in shingle_sets(batch.column("text"), SIZE):
                sets.append((one >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                size += len(one)
                if size >= GATHER:
                    yield flush(sets)
                    sets, size = [], 0
        if size:
            yield flush(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def level(part: int, held: np.ndarray) -> pa.RecordBatch:
            most = held.reshape(slots, -1).max(1)
            levels = np.where(most > 1, np.log2(np.maximum(most, 1)), 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary()), pa.array([int(held.sum())], pa.int64())], ["part", "levels", "total"])

        now, held = None, np.zeros(cells, np.int64)
        for batch in batches:
            for part, low, high, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield level(now, held)
                    now = part
                    held[:] = 0
                at = np.frombuffer(low, np.uint16) | (np.frombuffer(high, np.uint8).astype(np.int32) << 16)
                held[at] += np.frombuffer(counts, np.uint32)  # a row names a cell once
        if now is not None:
            yield level(now, held)

    place = work_dir(spark, "commonness")
    texts = docs.select(text_or_empty().alias("text"))
    dealt = texts.mapInArrow(gather, "part int, low binary, high binary, counts binary").repartition("part").sortWithinPartitions("part")
    levels = land(dealt.mapInArrow(count, "part int, levels binary, total bigint"), place)
    total = levels.agg(F.sum("total")).first()[0] or 0
    full = max(0, int(np.log2(max(total, 1))) - CELL_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for raw in batch.column("levels").to_pylist():
                one = np.frombuffer(raw, np.uint8).astype(np.int16)
                one = np.where(one > 0, np.clip(one - full, 1, 15), 0).astype(np.uint8)
                packed.append((one[0::2] | (one[1::2] << 4)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(packed, pa.binary())], ["part", "packed"])

    table = np.zeros((parts, slots // 2), np.uint8)
    for row in levels.mapInArrow(pack, "part int, packed binary").toLocalIterator():  # 4096 rows of 4 KB
        table[row["part"]] = np.frombuffer(row["packed"], np.uint8)
    remove(spark, place)
    return table.reshape(-1)


def _classes_of(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8)) & 15


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of the first elements of a set of n one of a similar set must share."""
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, held: Broadcast) -> DataFrame:
    """For each document: n, two fingerprints of its set, its group key, and the shared shingles of its prefix.

    Shingles that only one document has (class 0) are not listed: they can't join anything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            n, high, low, key, shared, places = [], [], [], [], [], []
            for one in shingle_sets(batch.column("text"), SIZE):
                n.append(len(one))
                high.append(int(mixed(one).sum(dtype=np.uint64).astype(np.int64)))
                low.append(int(mixed(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                kind = _classes_of(table, one)
                order = np.argsort(kind, kind="stable")[: prefix_length(len(one))] if len(one) else np.zeros(0, int)
                chosen, common = one[order], kind[order] > 0
                key.append(int(mixed(chosen).sum(dtype=np.uint64).astype(np.int64)))
                shared.append(chosen[common].astype(np.int64))
                places.append(np.flatnonzero(common).astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(key, pa.int64()), pa.array(shared, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "high", "low", "gkey", "shared", "places"])

    schema = f"doc_id {_kind(docs)}, n bigint, high bigint, low bigint, gkey bigint, shared array<bigint>, places array<int>"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def shingle_table(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) with the whole set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size, lo = batch.column("doc_id"), [], 0, 0
            for i, one in enumerate(shingle_sets(batch.column("text"), SIZE)):
                sets.append(one.astype(np.int64))
                size += len(one)
                if size >= GATHER:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
                    sets, size, lo = [], 0, i + 1
            if sets:
                yield pa.RecordBatch.from_arrays([ids.slice(lo), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {_kind(docs)}, shingles array<bigint>")


def _fits(a: str = "l", b: str = "r"):
    """The size and position filters for two index entries of one shingle.

    Sizes must be within PERCENT of each other. If the shingle is the first that the two sets share, no more than what
    follows it can be shared; a linked pair passes at its first shared shingle.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (rest * (100 + PERCENT) >= PERCENT * (na + nb))


def _may_fit():
    """Whether an entry can pass _fits() with the smallest set of its list that its size allows."""
    other = F.greatest(F.col("least_n").cast("double"), F.col("n") * (PERCENT / 100))
    return (F.col("n") - F.col("place")) * (100 + PERCENT) >= PERCENT * (F.col("n") + other) - 1e-6


def verified(pairs: DataFrame, docs: DataFrame, place: str) -> DataFrame:
    """The pairs (a, b) of class representatives whose whole sets link, written below `place`."""
    spark = docs.sparkSession
    named = land(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct(), f"{place}-named")
    texts = docs.join(sized(named), F.col("doc_id") == F.col("_id"), "left_semi")
    sets = land(shingle_table(texts).dropDuplicates(["doc_id"]), f"{place}-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(left, "a").join(right, "b").filter(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    links = land(links, f"{place}-links")
    for part in ("named", "sets"):
        remove(spark, f"{place}-{part}")
    return links


def _unsettled(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys under which there are several components."""
    several = rows.groupBy(key).agg(F.min("comp").alias("from"), F.max("comp").alias("to")).filter(F.col("from") < F.col("to")).select(key)
    return rows.join(several, key, "left_semi")


def _across(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs (l, r) of rows of one key and of different components; rows of one component never meet."""
    comps = rows.select(key, "comp").distinct()
    meet = comps.alias("x").join(comps.alias("y"), F.expr(f"x.{key} = y.{key} and x.comp < y.comp")).select(F.col(f"x.{key}").alias("_key"), F.col("x.comp").alias("_l"), F.col("y.comp").alias("_r"))
    own = F.struct(*columns)
    left = rows.select(F.col(key).alias("_key"), F.col("comp").alias("_l"), own.alias("l"))
    right = rows.select(F.col(key).alias("_key"), F.col("comp").alias("_r"), own.alias("r"))
    return meet.join(left, ["_key", "_l"]).join(right, ["_key", "_r"]).select("l", "r")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= 80 * |union| of their sets of distinct 5-word shingles (ASCII
    letters in lower case; with fewer words the whole sequence is one shingle). Null, empty and blank texts have no
    set and no link. component_id is the smallest doc_id reachable by links, the document's own included; rows without
    an id are given back with null. Rows that repeat an id must repeat its text; each is returned. An empty table
    gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    place = work_dir(spark, "ngram")
    held = spark.sparkContext.broadcast(commonness(docs))
    sets = land(prefixes(docs, held), f"{place}/prefixes")
    held.destroy()

    # Classes of equal sets, each named by its smallest document.
    named = sets.filter("n > 0 and doc_id is not null")
    classes = land(named.groupBy("high", "low", "n").agg(F.min("doc_id").alias("cid")), f"{place}/classes")
    reps = named.filter(F.size("shared") > 0).join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi")
    reps = land(reps.dropDuplicates(["doc_id"]), f"{place}/reps")

    # Groups: classes with the same prefix and size; one of them stands for the group in the index.
    groups = land(reps.groupBy("gkey", "n").agg(F.min("doc_id").alias("gid")), f"{place}/groups")
    members = land(reps.select("gkey", "n", F.col("doc_id").alias("cid")).join(groups, ["gkey", "n"]).select("gid", "cid"), f"{place}/members")
    heads = reps.join(groups.select(F.col("gid").alias("doc_id")), "doc_id", "left_semi")
    entries = heads.select(F.col("doc_id").alias("gid"), "n", F.explode(F.arrays_zip("shared", "places")).alias("e"))
    entries = entries.select("gid", "n", F.col("e.shared").alias("shingle"), F.col("e.places").alias("place"))
    firsts = entries.groupBy("shingle").agg(F.min(F.struct("gid", "n", "place")).alias("first"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    firsts = land(firsts, f"{place}/firsts")
    index = land(entries.join(sized(firsts), "shingle").filter(_may_fit()), f"{place}/index")

    # Round 1: each entry against the smallest group of its list, and each member against its group's smallest.
    starred = index.filter("gid <> first.gid").select(F.col("first").alias("l"), F.struct("gid", "n", "place").alias("r")).filter(_fits())
    pairs = starred.select(F.col("l.gid").alias("gl"), F.col("r.gid").alias("gr")).distinct()
    across = pairs.join(members.select(F.col("gid").alias("gr"), F.col("cid").alias("b")), "gr").select(F.col("gl").alias("a"), "b")
    back = pairs.join(members.filter("cid <> gid").select(F.col("gid").alias("gl"), F.col("cid").alias("b")), "gl").select(F.col("gr").alias("a"), "b")
    within = members.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    tried = land(across.unionByName(back).unionByName(within).distinct(), f"{place}/tried")
    links = verified(tried, docs, f"{place}/1")
    found = components(links)

    # Round 2: what shares a list, or a group, and is still apart. Only entries of different components meet.
    at = members.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("gid", "cid", F.coalesce("component", "cid").alias("comp"))
    at = land(at, f"{place}/at")
    listed = index.select("shingle", "gid", "n", "place").join(at.select("gid", "comp").distinct(), "gid")
    still = land(_unsettled(listed, "shingle"), f"{place}/open")
    rest = _across(still, "shingle", ["gid", "n", "place"]).filter(_fits() & (F.col("l.gid") != F.col("r.gid"))).select(F.col("l.gid").alias("gl"), F.col("r.gid").alias("gr")).distinct()
    lm, rm = at.select(F.col("gid").alias("gl"), F.col("cid").alias("a"), F.col("comp").alias("ca")), at.select(F.col("gid").alias("gr"), F.col("cid").alias("b"), F.col("comp").alias("cb"))
    crossed = rest.join(lm, "gl").join(rm, "gr").filter("ca <> cb").select("a", "b")
    inside = _across(_unsettled(at, "gid"), "gid", ["cid"]).select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b"))
    more = crossed.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = land(more.join(done, ["a", "b"], "left_anti"), f"{place}/more")
    if not more.isEmpty():
        found = components(links.unionByName(verified(more, docs, f"{place}/2")))
    for part in ("reps", "groups", "members", "firsts", "index", "tried", "at", "open", "more", "1-links", "2-links"):
        remove(spark, f"{place}/{part}")
    # Only texts with words have a class.
    result = sets.filter("n > 0").select("doc_id", "high", "low", "n").join(classes, ["high", "low", "n"], "left")
    result = result.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("doc_id", "n", F.coalesce("component", "cid", "doc_id").alias("component"))
    result = result.unionByName(sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id; rows without an id stay."""
    found = near_duplicates(docs, doc_id, text)
    gone = land(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), work_dir(docs.sparkSession, "near"))
    gone = sized(gone)
    return docs.join(gone, docs[doc_id] == gone["_id"], "left_anti")
