"""Importable documents: one well-formed XML file per site, large sites in numbered parts.

A file is made of lines: a head, an item per line (its text may hold line feeds), a foot. The lines of a file are one sorted group of a shuffle by
(site, part), so a large site is spread over tasks, a task writes one file at a time, and the text writer's own commit protocol makes the result appear as a whole,
on any file system that Spark writes to. Lines are native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.export import NAMESPACES, RSS_VERSION, wxr_item_columns
from .files import SITE_BUCKETS, site_bucket

ITEMS_PER_FILE = 5_000
KEY = ["site_bucket", "site", "part"]


def _escaped(value: Column) -> Column:
    """Text of an element; a carriage return would be read as a line feed if it stood there as it is."""
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        value = F.replace(value, F.lit(plain), F.lit(name))
    return value


def _element(name: str, value: Column, attributes: dict[str, Column] | None = None) -> Column:
    opened = [F.lit(f"<{name}")]
    for attribute, text in (attributes or {}).items():
        opened += [F.lit(f' {attribute}="'), F.replace(_escaped(text), F.lit('"'), F.lit("&quot;")), F.lit('"')]
    return F.concat(*opened, F.lit(">"), F.coalesce(_escaped(value.cast("string")), F.lit("")), F.lit(f"</{name}>"))


def item_line(named: DataFrame) -> Column:
    """The XML of a row of ``wxr_item_columns``."""
    parts = []
    for field in named.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            attributes = {f.name.removeprefix("_"): column[f.name] for f in field.dataType.fields if f.name != "_VALUE"}
            parts.append(_element(field.name, column["_VALUE"], attributes))
        elif field.name not in ("site", "position"):
            parts.append(_element(field.name, column))
    return F.concat(F.lit("<item>"), *parts, F.lit("</item>"))


def head_line() -> Column:
    spaces = " ".join(f'xmlns:{prefix}="{uri}"' for prefix, uri in NAMESPACES.items())
    names = {"title": "title", "link": "link", "description": "description", "pubDate": "pub_date", "language": "language", "wp:wxr_version": "wxr_version"}
    opened = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="{RSS_VERSION}" {spaces}>\n<channel>\n')
    return F.concat(opened, *[_element(element, F.col(column)) for element, column in names.items()])


def import_lines(items: DataFrame, channel: DataFrame, per_file: int = ITEMS_PER_FILE) -> DataFrame:
    """``site, part, place, line`` of all files. ``items`` have a ``position``, from 1 in their site; sites without a header have no file."""
    if per_file < 1:
        raise ValueError("a file holds at least one item")
    part = F.expr(f"(position - 1) div {per_file}").alias("part")
    named = wxr_item_columns(items)
    told = named.join(channel.select("site"), "site", "left_semi").select("site", part, F.col("position").alias("place"), item_line(named).alias("line"))
    sizes = items.groupBy("site").agg(F.max("position").alias("n"))  # narrow: no text is read for it
    files = channel.join(sizes, "site").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {per_file}"))))
    heads = files.select("site", "part", F.lit(0).cast("bigint").alias("place"), head_line().alias("line"))
    feet = files.select("site", "part", F.lit((1 << 63) - 1).alias("place"), F.lit("</channel>\n</rss>").alias("line"))
    return told.unionByName(heads).unionByName(feet)


def write_import_files(items: DataFrame, channel: DataFrame, path: str, per_file: int = ITEMS_PER_FILE, buckets: int = SITE_BUCKETS) -> None:
    """Write ``<path>/site_bucket=/site=/part=/*.txt``, one file in each."""
    lines = import_lines(items, channel, per_file).withColumn("site_bucket", site_bucket("site", buckets))
    ordered = lines.repartition("site", "part").sortWithinPartitions(*KEY, "place")
    ordered.select(*KEY, "line").write.mode("overwrite").partitionBy(*KEY).text(path)
