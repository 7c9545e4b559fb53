"""Filter trees, sort lists and keyset pages over typed columns and relations."""
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import buckets


@dataclass(frozen=True)
class Relation:
    """Rows of another table that belong to a row: other[theirs] = row[ours]; its own fields may be named in a path."""

    other: DataFrame
    theirs: str
    ours: str
    relations: dict = field(default_factory=dict)


# Operators on one field: name to a function of the column and the given value.
FIELD = {
    "$eq": lambda c, v: c.isNull() if v is None else c == v, "$ne": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(F.lit(v)),
    "$eqi": lambda c, v: F.lower(c) == str(v).lower(), "$nei": lambda c, v: ~F.lower(c).eqNullSafe(F.lit(str(v).lower())),
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False), "$notIn": lambda c, v: c.isNull() | ~c.isin(*v) if v else F.lit(True),
    "$between": lambda c, v: c.between(*v), "$null": lambda c, v: c.isNull() if v else c.isNotNull(), "$notNull": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$contains": lambda c, v: F.contains(c, F.lit(str(v))), "$notContains": lambda c, v: F.coalesce(~F.contains(c, F.lit(str(v))), F.lit(True)),
    "$containsi": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())), "$notContainsi": lambda c, v: F.coalesce(~F.contains(F.lower(c), F.lit(str(v).lower())), F.lit(True)),
    "$startsWith": lambda c, v: c.startswith(str(v)), "$startsWithi": lambda c, v: F.lower(c).startswith(str(v).lower()),
    "$endsWith": lambda c, v: c.endswith(str(v)), "$endsWithi": lambda c, v: F.lower(c).endswith(str(v).lower()),
}


def _truth(c: Column, negated: bool) -> Column:
    """A row is in or out: what compares with null is out, and so in under a negation, where that must be said.

    Elsewhere null leaves a row out by itself, and plain comparisons can reach the scan."""
    return F.coalesce(c, F.lit(False)) if negated else c


class Compiled:
    """A filter tree as one condition, with the joins that it needs of relations."""

    def __init__(self, df: DataFrame, relations: dict[str, Relation]):
        self.df, self.relations, self.made = df, relations, 0

    def tree(self, node: dict, negated: bool = False) -> Column:
        out = F.lit(True)
        for name, value in node.items():
            out = out & self.part(name, value, negated)
        return out

    def part(self, name: str, value, negated: bool) -> Column:
        if name in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{name} takes a list")
            parts = [self.tree(x, negated) for x in value]
            if name == "$or" and parts:
                out = F.lit(False)
                for p in parts:
                    out = out | p
                return out
            out = F.lit(True)
            for p in parts:
                out = out & p
            return out
        if name == "$not":
            return ~self.tree(value, True)
        if name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        if name in self.relations:
            return self.related(self.relations[name], value)
        if name not in self.df.columns:
            raise ValueError(f"unknown field {name}")
        return self.field(F.col(name), value, negated)

    def field(self, c: Column, value, negated: bool) -> Column:
        if isinstance(value, (list, tuple)):
            return _truth(FIELD["$in"](c, list(value)), negated)
        if not isinstance(value, dict):
            return _truth(FIELD["$eq"](c, value), negated)
        out = F.lit(True)
        for op, v in value.items():
            if op == "$not":
                out = out & ~self.field(c, v, True)
            elif op in ("$and", "$or"):
                parts = [self.field(c, x, negated) for x in v]
                joined = F.lit(op == "$and" or not parts)
                for p in parts:
                    joined = joined & p if op == "$and" else joined | p
                out = out & joined
            elif op in FIELD:
                out = out & _truth(FIELD[op](c, v), negated)
            else:
                raise ValueError(f"unknown operator {op}")
        return out

    def related(self, relation: Relation, value) -> Column:
        """Whether any related row fits: the fitting rows' keys, each once, meet the rows by an outer join."""
        side = filtered(relation.other, value if isinstance(value, dict) else {relation.theirs: value}, relation.relations)
        self.made += 1
        mark = f"__related{self.made}"
        keys = side.select(F.col(relation.theirs).alias(f"{mark}_key")).where(F.col(f"{mark}_key").isNotNull()).distinct().withColumn(mark, F.lit(True))
        self.df = self.df.join(keys, F.col(relation.ours) == F.col(f"{mark}_key"), "left").drop(f"{mark}_key")
        return F.coalesce(F.col(mark), F.lit(False))


def filtered(df: DataFrame, tree: dict, relations: dict[str, Relation] = {}) -> DataFrame:
    """Rows of df that a filter tree keeps.

    A tree has fields, relations, and $and, $or, $not of trees; all entries of a tree must hold. A field has a value (null:
    is null), a list ($in) or operators: $eq, $ne, $eqi, $nei, $lt, $lte, $gt, $gte, $in, $notIn, $between, $null, $notNull,
    $contains, $startsWith, $endsWith with their i and not forms, and $and, $or, $not of these. A relation holds if a
    related row fits its tree. An empty $in keeps nothing, an empty tree all. Unknown fields and operators raise an error.
    Conditions on own fields alone are plain conditions, so they reach the scan; a relation that must hold at the top of
    the tree is a semi-join."""
    own = list(df.columns)
    top = dict(tree)
    for name in [n for n in top if n in relations]:
        relation, value = relations[name], top.pop(name)
        side = filtered(relation.other, value if isinstance(value, dict) else {relation.theirs: value}, relation.relations)
        df = df.join(side.select(F.col(relation.theirs).alias("__theirs")), F.col(relation.ours) == F.col("__theirs"), "left_semi")
    compiled = Compiled(df, relations)
    condition = compiled.tree(top)
    return compiled.df.where(condition).select(*own)


def sort_columns(order: list[str], columns: list[str]) -> list[tuple[str, bool]]:
    """(field, descending) of 'field', 'field:asc' and 'field:desc'."""
    out = []
    for item in order:
        name, _, way = item.partition(":")
        if name not in columns or way.lower() not in ("", "asc", "desc"):
            raise ValueError(f"unknown sort {item}")
        out.append((name, way.lower() == "desc"))
    return out


def page_after(df: DataFrame, order: list[str], size: int = 25, after: tuple | None = None, most: int = 100) -> DataFrame:
    """The rows that follow the one with the sort values ``after`` (None: from the start), in order, ``size`` of them, ``most`` at most.

    Nulls stand first in ascending and last in descending order. The order must tell rows apart, so its last field is
    usually the id: then pages in a row give every row once, ties and nulls included, and a page reads what its bounds
    let through, however far it is from the start, where an offset would sort all rows before it."""
    keys = sort_columns(order, df.columns)
    if after is not None:
        if len(after) != len(keys):
            raise ValueError("a bound has one value for each sort field")
        later, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(keys, after):
            c = F.col(name)
            if value is None:
                beyond = F.lit(False) if down else c.isNotNull()
            else:
                beyond = (c < value) | c.isNull() if down else c > value
            later = later | equal & F.coalesce(beyond, F.lit(False))
            equal = equal & c.eqNullSafe(F.lit(value))
        # Stated by itself, the first field's bound can prune row groups.
        name, down = keys[0]
        if after[0] is not None and not down:
            df = df.where(F.col(name) >= after[0])
        df = df.where(later)
    by = [F.desc_nulls_last(n) if down else F.asc_nulls_first(n) for n, down in keys]
    return df.orderBy(*by).limit(max(1, min(size, most)))


def page_bounds(df: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """page, total, and the sort values of each page's last row as bound: where the next page begins.

    Sort values are dealt by ranges and written once; rows are then numbered range by range, so no task holds more than
    one, and the total comes from the same counts."""
    keys = sort_columns(order, df.columns)
    by = [F.desc_nulls_last(n) if down else F.asc_nulls_first(n) for n, down in keys]
    names = [n for n, _ in keys]
    path = buckets.scratch(df.sparkSession, "order")
    df.select(*names).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    parts = df.sparkSession.read.schema(df.select(*names, F.lit(0).alias("__part")).schema).parquet(path)
    ranked = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    # One row a range: the rows of ranges before it, and of all.
    sizes = parts.groupBy("__part").agg(F.count("*").alias("rows"))
    every = Window.partitionBy(F.lit(0))
    ahead = sizes.select("__part", F.coalesce(F.sum("rows").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("rows").over(every).alias("total"))
    out = ranked.join(F.broadcast(ahead), "__part").withColumn("__n", F.col("__n") + F.col("__ahead"))
    out = out.where((F.col("__n") % size == 0) | (F.col("__n") == F.col("total")))
    return out.select(F.ceil(F.col("__n") / size).cast("int").alias("page"), "total", F.struct(*names).alias("bound"))


def found(df: DataFrame, tree: dict = {}, fields: list[str] | None = None, populate: dict[str, list[str]] = {}, relations: dict[str, Relation] = {}, order: list[str] = ["id"], size: int = 25, after: tuple | None = None) -> DataFrame:
    """A page of the rows that a filter tree keeps, with the fields asked for and related rows as arrays.

    populate has the fields of each relation that is to come along: a sorted array of structs, empty where nothing is
    related. Only relations of the page's rows are gathered. Unknown fields, relations and sorts raise an error."""
    for name in populate:
        if name not in relations:
            raise ValueError(f"unknown relation {name}")
    page = page_after(filtered(df, tree, relations), order, size, after)
    fields = fields or list(df.columns)
    for f in fields:
        if f not in df.columns:
            raise ValueError(f"unknown field {f}")
    out = page.select(*dict.fromkeys([*fields, *(relations[n].ours for n in populate)]))
    for name, wanted in populate.items():
        relation = relations[name]
        keys = page.select(F.col(relation.ours).alias(relation.theirs)).where(F.col(relation.theirs).isNotNull()).distinct()
        side = relation.other.join(F.broadcast(keys), relation.theirs, "left_semi").groupBy(F.col(relation.theirs).alias("__theirs")).agg(F.array_sort(F.collect_list(F.struct(*wanted))).alias(name))
        out = out.join(side, F.col(relation.ours) == F.col("__theirs"), "left").drop("__theirs").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out.select(*fields, *populate)
