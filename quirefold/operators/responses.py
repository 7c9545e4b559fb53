"""Nested responses: results as one JSON text of sorted lists and objects."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(df: DataFrame, order: list[tuple[str, bool]], fields: dict[str, str] | None = None, name: str = "items") -> DataFrame:
    """One row: name, an array of structs of all rows in order of (column, descending), fields being {key: column}.

    Rows are gathered as they are and sorted as an array, so a response should be a page or a report, not a corpus. A
    column that sorts downwards must be a number. Nulls come first, upwards and downwards alike."""
    fields = fields or {c: c for c in df.columns}
    keys = F.struct(*((-F.col(c) if down else F.col(c)).alias(f"k{i}") for i, (c, down) in enumerate(order)))
    rows = df.select(keys.alias("k"), F.struct(*(F.col(c).alias(key) for key, c in fields.items())).alias("row"))
    # Only what the order says counts, ties go by the whole row.
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias(name))


def grouped(df: DataFrame, by: list[str], order: list[tuple[str, bool]], fields: dict[str, str], name: str) -> DataFrame:
    """A row a group: by, and the sorted array of its rows: the inner level of a two-level response."""
    keys = F.struct(*((-F.col(c) if down else F.col(c)).alias(f"k{i}") for i, (c, down) in enumerate(order)))
    rows = df.select(*by, keys.alias("k"), F.struct(*(F.col(c).alias(key) for key, c in fields.items())).alias("row"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias(name))


def response(*parts: DataFrame | tuple[str, Column], nulls: bool = True, name: str = "response") -> DataFrame:
    """One row with the JSON of one-row parts, keys in the order given; null values are written, or with nulls=False left out."""
    frames = [p for p in parts if isinstance(p, DataFrame)]
    values = [c for p in parts for c in (p.columns if isinstance(p, DataFrame) else [p[0]])]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    one = one.withColumns({p[0]: p[1] for p in parts if not isinstance(p, DataFrame)})
    return one.select(F.to_json(F.struct(*values), {"ignoreNullFields": str(not nulls).lower()}).alias(name))
