"""File readers and writers, databases and parameterised statements."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_csv(spark: SparkSession, path: str, trim: bool = True, strict: bool = False) -> DataFrame:
    """Quoted CSV with line breaks in cells; headers lower-cased, missing cells empty, blank rows dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, mode="DROPMALFORMED" if strict else "PERMISSIVE")
    df = df.toDF(*(c.strip().lower() for c in df.columns)).na.fill("")
    return df.where(F.concat_ws("", *(T.trim(F.col(f"`{c}`")) for c in df.columns)) != "")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """form, lemma from 'lemma<TAB>form' lines; each lemma is also its own form unless listed."""
    df = spark.read.csv(path, sep="\t", schema="lemma string, form string").select(
        *(F.lower(T.trim(F.replace(c, F.lit("﻿"), F.lit("")))).alias(c) for c in ("lemma", "form")), F.monotonically_increasing_id().alias("line")).where("form is not null")
    forms = df.groupBy("form").agg(F.max_by("lemma", "line").alias("lemma"))
    own = df.select(F.col("lemma").alias("form"), "lemma").distinct().join(forms, "form", "left_anti")
    return forms.unionByName(own)


def read_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a database; with bounds (column, lowest, highest, parts) it is read in so many ranges of the column at once.

    Rows outside of the bounds belong to the first and last range, so none is lost."""
    if bounds is not None:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), bounds))
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: Parts of a statement that may look like markers but are text, names or remarks.
QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"


def sql(spark: SparkSession, statement: str, values=(), **tables: DataFrame) -> DataFrame:
    """A statement over the given tables, with values bound to its markers: ? and $1 by order, :name by name.

    Values are bound after parsing, so whatever they hold stays a value. A list for one marker, as in array_contains(:ids,
    id), is an array. Tables are temporary views for this statement alone."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        if isinstance(values, dict):
            return spark.sql(statement, args=values)
        values = list(values)
        numbered = {int(m[1]) for m in re.finditer(rf"{QUOTED}|\$([0-9]+)", statement, re.S) if m[1]}
        if numbered:
            if max(numbered) > len(values) or min(numbered) < 1:
                raise ValueError("a marker has no value")
            text = re.sub(rf"({QUOTED})|\$([0-9]+)", lambda m: m[1] or f":__{m[2]}", statement, flags=re.S)
            return spark.sql(text, args={f"__{i}": values[i - 1] for i in numbered})
        return spark.sql(statement, args=values) if values else spark.sql(statement)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', mode="overwrite")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")
