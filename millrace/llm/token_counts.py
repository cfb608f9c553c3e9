"""Token counts through a cache of digests.

Counts are kept in a Parquet table (digest, version, n_tokens): the digest of the normalised content and the digest of
the tokenizer's file. A run joins the digests of its documents to the table, encodes each distinct text that the table
lacks once, appends the new counts, and joins again. Texts move in one shuffle only, and there each task sends a text
once: copies are dropped before the shuffle, so a text that a third of all rows share costs its task one encoding.

Normalising replaces null by the empty text and nothing else, since any other change could change the count.
Null and empty texts have 0 bytes and 0 tokens. Rows that repeat, also with the same id, are returned as often as they
come; a null id is returned as it is. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, scratch_path, slices, texts_of

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text), each text once for this task."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        digests, texts = [], []
        for text in texts_of(batch):
            digest = hashlib.sha256(text).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], ["digest", "text"])


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pairs = bpe.load(path)
        for batch in slices(batches):
            digests, counts = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(pairs.count(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([version] * len(digests), pa.string()), pa.array(counts, pa.int64())],
                ["digest", "version", "n_tokens"],
            )

    return encode


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache table; empty where nothing has been stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def add_misses(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text") -> str:
    """Encode what the cache lacks for this tokenizer and append it. Gives the tokenizer's version."""
    version = bpe.file_digest(tokenizer_path)
    known = read_cache(docs.sparkSession, cache_path).where(F.col("version") == version).select("digest")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_distinct_texts, "digest binary, text string")
    misses = texts.join(known, "digest", "left_anti")
    misses.repartition("digest").mapInArrow(_encoder(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return version


def token_counts(
    docs: DataFrame, cache_path: str | None = None, tokenizer_path: str | None = None, limit: int = 1024, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs.

    cache_path: the table of counts, in a folder that all executors share; without it, a new one.
    limit: over_limit tells that a text has more tokens than that.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or bpe.default_path()
    cache_path = cache_path or scratch_path(spark, "token_counts")
    version = add_misses(docs, cache_path, tokenizer_path, text)
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    # two runs may have appended the same digest at the same time; written down, so that a digest of many documents can be split in the join
    counts = materialize(read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
