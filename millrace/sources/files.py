"""Files as tables: JSON, walks, fingerprints, traces, chunks; and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """[S-01] Whole JSON documents, UTF-8, with or without a byte-order mark."""
    reader = spark.read.option("multiLine", "true").option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """[S-02] One small document, whole or not at all: written beside its place, then renamed into it, by the file system of the path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
        out.hsync() if fs.getScheme() == "hdfs" else out.flush()
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} could not be put in its place")


def walk(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """[S-27] (path, size, modified) of all files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """[S-27, F-19] (path, size, lines, digest) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.col("length").alias("size"), F.regexp_count(text, F.lit("\n")).cast("long").alias("lines"), F.sha2("content", 256).alias("digest"))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S-31] JSON parts of a folder with chapter: their own field, else the number in the file's name."""
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    named = F.regexp_extract("file", r"ch-0*(\d+)", 1).try_cast("int")
    own = F.col("chapter") if "chapter" in rows.columns else F.lit(None).cast("int")
    return rows.withColumn("chapter", F.coalesce(own, named))


def write_csv(df: DataFrame, path: str) -> None:
    """[S-28] CSV with a header whose first name carries the byte-order mark that spreadsheet programs look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = 30_000) -> DataFrame:
    """[S-18] (key, chunk, part): texts in pieces of at most that many characters; a null or empty text has one empty piece."""
    value = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.ceil(F.length(value) / size), F.lit(1)).cast("int")
    parts = docs.select(key, value.alias("value"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return parts.select(key, "chunk", F.substr("value", F.col("chunk") * size + 1, F.lit(size)).alias("part"))


def _one_value(text: Column) -> Column:
    """JSON text as an array of its one value; null if it isn't JSON, or more follows, which the parser alone would pass over."""
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(parsed, "$[1]", "variant").isNull(), parsed)


def trace_models(lines: DataFrame, value: str = "value") -> DataFrame:
    """[S-20] (provider, model) of completed events in lines of JSON, each once; lines that aren't JSON are passed over."""
    parsed = _one_value(F.col(value))
    get = lambda p: F.try_variant_get(parsed, "$[0]" + p[1:], "string")
    rows = lines.where(parsed.isNotNull()).where((get("$.event") == "completed") & get("$.modelId").isNotNull())
    return rows.select(get("$.provider").alias("provider"), get("$.modelId").alias("model")).distinct().orderBy("provider", "model")


def sse_events(lines: DataFrame, wanted_id: Column, value: str = "value") -> DataFrame:
    """[S-19] (body): payloads of `data:` lines of an event stream whose JSON has the wanted id."""
    body = F.trim(F.substring(F.col(value), 6, 1 << 30))
    rows = lines.where(F.startswith(F.col(value), F.lit("data:"))).select(body.alias("body"))
    return rows.where(F.try_variant_get(_one_value(F.col("body")), "$[0].id", "string") == wanted_id.cast("string"))


def json_bundle(df: DataFrame, order: str) -> DataFrame:
    """[S-33] One row, bundle: the rows in order as a JSON array that may stand inside a script element. For results of a page's size."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j")))), lambda x: x["j"])
    return df.agg(F.replace(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")), F.lit("</"), F.lit("<\\/")).alias("bundle"))


def best_format(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """[S-09] (folder, name, rank, status): the best file of each folder: EPUB before PDF before Kindle formats, then the longer name;
    below PDF a folder has nothing to extract."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.([A-Za-z0-9]+)$", 1))
    ranked = files.withColumn("rank", F.when(ext == "epub", 4).when(ext == "pdf", 3).when(ext.isin("azw3", "mobi"), 1).otherwise(0))
    best = ranked.groupBy(folder).agg(F.max_by(F.struct(F.col(name).alias("name"), F.col("rank").alias("rank")), F.struct("rank", F.length(name), name)).alias("b"))
    return best.select(folder, "b.name", "b.rank", F.when(F.col("b.rank") >= 3, "extract").otherwise("skip").alias("status"))
