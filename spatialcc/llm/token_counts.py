"""Token counts through a digest cache.

Content digests are joined with the counts stored for the tokenizer's digest; only distinct misses are encoded, and
their counts are appended to the cache.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import content_digest, exists, land, text_or_empty, visit_once, work_dir

#: Tokens beyond which a document is over the limit.
LIMIT = 512

# What the byte-level pre-tokenizer splits at.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside these ranges may be classed differently by the two libraries' Unicode tables.
_SURE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏͰ-ͷͺ-ͽΆ-ΡΣ-ӿ‐-‧‰-⁞€]")


def tokenizer_digest(path: str) -> str:
    """A digest of the tokenizer's file, its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks of a plain byte-level BPE whose ids follow its merges; None for any other model."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    vocab, letters = model["vocab"], _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts as the library for the file does, without added special tokens.

    It is made once in a process: tables of a tokenizer take some hundred megabytes while they are built.

    .json: tokenizers; .model: sentencepiece; .tiktoken: tiktoken. A plain byte-level .json is counted with the faster
    merges of tiktoken wherever a text has only characters that both libraries class alike and no special string;
    the other texts go through tokenizers itself.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tiktoken

    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]

    @functools.lru_cache(maxsize=1)
    def library():
        import tokenizers

        held = tokenizers.Tokenizer.from_file(path)
        held.no_truncation()
        held.no_padding()
        return held

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _byte_level_ranks(spec)
    if ranks is None:
        return lambda texts: [len(x.ids) for x in library().encode_batch(texts, add_special_tokens=False)]
    encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t["content"] for t in spec["added_tokens"]]

    def count(texts: list[str]) -> list[int]:
        return [
            len(library().encode(x, add_special_tokens=False).ids) if _SURE.search(x) or any(s in x for s in special) else len(encoding.encode_ordinary(x))
            for x in texts
        ]

    return count


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for the rows (digest, text), a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        for batch in batches:
            column, counts = batch.column("text"), []
            for i in range(0, len(column), 64):
                counts += count(column.slice(i, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, digest, n_bytes, n_tokens) for each row of `docs`.

    path: the tokenizer's file, at the same place on every machine. cache: a folder that keeps counts between runs;
    without one a fresh folder is used. Normalised content is the text with null as empty: any further change would
    alter counts. Equal texts, repeated rows included, are encoded once; null ids are kept; an empty table gives an
    empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    place = f"{cache or work_dir(spark, 'tokens')}/tokenizer={tokenizer_digest(path)[:32]}"
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    versions = docs.select("doc_id", content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    versions = land(versions, work_dir(spark, "versions"))
    misses = versions.select("digest").distinct()
    schema = "digest binary, n_tokens bigint"
    if exists(spark, place):
        misses = misses.join(spark.read.schema(schema).parquet(place), "digest", "left_anti")
    rows = visit_once(docs, versions.select("doc_id", "digest"), misses)
    fresh = encode_counts(rows.select(content_digest(F.col("text")).alias("digest"), "text"), path).dropDuplicates(["digest"])
    fresh.write.mode("append").parquet(place)
    # A run that was cut short may have been repeated. Landed, so that the join may split the rows of one digest.
    stored = spark.read.schema(schema).parquet(place).join(versions.select("digest"), "digest", "left_semi") if cache else spark.read.schema(schema).parquet(place)
    stored = land(stored.dropDuplicates(["digest"]), work_dir(spark, "stored"))
    return versions.join(stored, "digest", "left")


def contract_columns(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The contract's columns."""
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
