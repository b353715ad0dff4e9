"""Other readers and the writers."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, gzipped or not, with a header and with # comments."""
    return spark.read.csv(path, schema=schema, header=True, comment="#")


def read_by_ids(frame: DataFrame, ids: DataFrame, key: str, columns: list[str], complete: bool = True) -> DataFrame:
    """The named columns of the rows whose key is in ``ids``; with ``complete`` a missing id is an error."""
    if complete and (missing := ids.select(key).distinct().join(frame.select(key), key, "left_anti").limit(3).collect()):
        raise ValueError(f"no row for {[r[0] for r in missing]}")
    return frame.select(*dict.fromkeys([key, *columns])).join(ids.select(key).distinct(), key, "left_semi")


def dig(json_text: Column, path: str) -> Column:
    return F.get_json_object(json_text, f"$.{path}")


def markdown_table(lines: DataFrame, header: str) -> DataFrame:
    """(name, value): first column and the column called ``header`` of the table that has it. lines: line_no, value."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim("value").startswith("|")).select("line_no", cells.alias("c"))
    rows = rows.withColumn("block", F.col("line_no") - F.row_number().over(_by("line_no")))
    heads = rows.where(F.array_contains("c", header)).groupBy("block").agg(F.min(F.struct("line_no", F.array_position("c", header).cast("int").alias("at"))).alias("h")).orderBy("h.line_no").limit(1)
    body = rows.join(heads, "block").where((F.col("line_no") > F.col("h.line_no")) & ~F.col("c")[0].rlike("^:?-+:?$"))
    return body.select(F.col("c")[0].alias("name"), F.try_element_at("c", F.col("h.at")).alias("value"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # one report file


def inventory(spark: SparkSession, path: str, samples: int = 5) -> DataFrame:
    """extension (compound ones too), files, bytes and up to ``samples`` names, over a folder tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"((?:\.tar|\.csv|\.json|\.jsonl)?\.[A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("[none]"))
    named = files.select(ext.alias("extension"), name.alias("name"), "length")
    counted = named.groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    # The first names of each extension; the limit of the window keeps no more than these.
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("extension").orderBy("name"))).where(F.col("n") <= samples)
    return counted.join(first.groupBy("extension").agg(F.array_sort(F.collect_list("name")).alias("samples")), "extension")


def describe(frame: DataFrame, depth: int = 3) -> list[tuple[str, str]]:
    """(column, type) with nested types cut below ``depth``."""

    def short(kind, left: int) -> str:
        if left == 0 and hasattr(kind, "fields"):
            return "struct<...>"
        if hasattr(kind, "fields"):
            return "struct<" + ",".join(f"{f.name}:{short(f.dataType, left - 1)}" for f in kind.fields) + ">"
        if hasattr(kind, "elementType"):
            return f"array<{short(kind.elementType, left - 1) if left else '...'}>"
        return kind.simpleString()

    return [(f.name, short(f.dataType, depth)) for f in frame.schema.fields]


def write_jsonl(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines, one folder for each value of ``partition_by``."""
    frame.write.partitionBy(*(partition_by or [])).json(path)


def write_csv(frame: DataFrame, path: str, separator: str = ",") -> None:
    """CSV with a header and a byte order mark at its first column's name; arrays are joined."""
    flat = [F.concat_ws(separator, c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in frame.dtypes]
    first, *rest = frame.columns
    frame.select(*flat).withColumnRenamed(first, "﻿" + first).select("﻿" + first, *rest).write.csv(path, header=True)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def write_summary(path: str, content: dict) -> None:
    """Pretty JSON with sorted keys; sets become sorted lists."""
    kinds = lambda x: sorted(x) if isinstance(x, set | frozenset) else str(x)
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True, ensure_ascii=False, default=kinds) + "\n", encoding="utf-8")


def manifest(config: dict, **facts) -> dict:
    """What a run was made from: hash of its configuration, and facts such as counts, seeds and times."""
    return {"config_sha256": config_hash(config), **facts}


class KeyedCache:
    """An append-only table of key and value. What is missing is an anti-join; of a key written twice one row is read."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key string, value double"):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            found = self.spark.read.schema(self.schema).parquet(self.path)
            found.take(1)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            found = self.spark.createDataFrame([], self.schema)
        return found.dropDuplicates(["key"])

    def missing(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.read(), "key", "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def text_table(rows: list[tuple], header: tuple[str, ...]) -> str:
    """A plain report table: thousands separated, columns aligned."""
    cells = [tuple(map(str, header)), *[tuple(f"{x:,}" if isinstance(x, int) else str(x) for x in r) for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)


def latex_table(rows: list[tuple], header: tuple[str, ...]) -> str:
    body = " \\\\\n".join(" & ".join(f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in [header, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(header)}}}\n{body} \\\\\n\\end{{tabular}}\n"
