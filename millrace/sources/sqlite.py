"""SQLite files as tables, and the items of a reference library kept in one."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_sqlite(files: DataFrame, table: str, schema: str) -> DataFrame:
    """[S-10] The columns of schema of one table of each SQLite file, with the file's path; files (path, content), as
    spark.read.format("binaryFile") gives them. The content is a snapshot: nothing is locked, and it is opened in memory, a file to a task."""
    names = [c.split()[0] for c in schema.split(", ")]
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    source = '"' + table.replace('"', '""') + '"'

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(bytes(content))
                    cursor = db.execute(f"SELECT {quoted} FROM {source}")
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame([(path, *r) for r in rows], columns=["path", *names]).astype(object)

    return files.select("path", "content").mapInPandas(scan, f"path string, {schema}")


def library_items(tables: dict[str, DataFrame], kinds: dict[str, str]) -> DataFrame:
    """[S-10, J-09, J-10, J-11, A-15] (path, key, type, title, date, authors, file, format): items with their attached files of `kinds`, a format
    for each content type, neither deleted. tables: items (item, key, type), item_types (type, name), attachments (item, parent, content_type,
    file), deleted (item), fields (field, name), data (item, field, value), values (value, text), creators (item, ord, given, family); all with
    path. Authors in order, parted by semicolons."""
    t = tables
    alive = t["items"].join(t["deleted"], ["path", "item"], "left_anti")
    facts = t["data"].join(t["fields"], ["path", "field"]).join(t["values"], ["path", "value"]).groupBy("path", "item").pivot("name", ["title", "date"]).agg(F.first("text"))
    name: Column = F.trim(F.concat_ws(" ", "given", "family"))
    authors = t["creators"].groupBy("path", "item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", name.alias("name")))), lambda x: x["name"]), "; ").alias("authors"))
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    attached = t["attachments"].join(t["deleted"], ["path", "item"], "left_anti").select("path", F.col("parent").alias("item"), "file", known[F.col("content_type")].alias("format")).where("format is not null")
    types = t["item_types"].select("path", F.col("type"), F.col("name").alias("type_name"))
    out = alive.join(types, ["path", "type"]).join(attached, ["path", "item"]).join(facts, ["path", "item"], "left").join(authors, ["path", "item"], "left")
    return out.select("path", "key", F.col("type_name").alias("type"), "title", "date", "authors", "file", "format")
