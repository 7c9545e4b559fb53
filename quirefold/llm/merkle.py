"""Merkle manifest of a dataset: levels are built bottom up and written, then proofs are pushed down from parents to children."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spent, written

WIDTH = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NONE = "cast(array() as array<struct<before:string,after:string>>)"


def encoded(*columns) -> Column:
    """The values one after another: '-' for null, else the number of UTF-8 bytes, ':' and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*(one(F.col(c) if isinstance(c, str) else c) for c in columns))


def digest(c) -> Column:
    return F.sha2(c, 256)


def folded(leaf, proof: str = "proof") -> Column:
    """Root that a leaf gives with the siblings of a proof, an array of what stands before and after it level by level."""
    return F.aggregate(proof, leaf, lambda held, level: digest(F.concat(level["before"], held, level["after"])))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, a written table, with the place (from 0) in its group and the group's size.

    Rows are dealt by ranges of (group, order) and counted part by part, so a group that holds most rows is split, and so
    are equal rows, which are told apart by where they stand in the table."""
    keys = [group, *order, "__at"]
    parts = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = written(parts.withColumn("__part", F.spark_partition_id()), "parts")
    counts = parts.groupBy(group, "__part").agg(F.count("*").alias("n"))
    over = Window.partitionBy(group)
    counts = counts.withColumn("size", F.sum("n").over(over)).withColumn("__ahead", F.sum("n").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce("__ahead", F.lit(0)).alias("__ahead"), "size")
    inside = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order, "__at")) - 1
    out = parts.withColumn("place", inside).join(counts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("place", F.col("place") + F.col("__ahead")).drop("__g", "__p", "__ahead", "__part", "__at")


def built(nodes: DataFrame, width: int = WIDTH) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) over the written nodes(tree, place, size, node), node being a struct whose field hash is the digest.

    A level holds runs: tree, place, size (of the level), kids (the structs of up to ``width`` consecutive nodes) and
    node(hash). A tree of one node is done: tops has tree and hash. Every level is written, a ``width``-th of the last."""
    levels, tops, at = [], nodes.where("size = 1").select("tree", "node.hash"), nodes
    most = nodes.agg(F.max("size")).first()[0]
    while most > 1:
        runs = at.where("size > 1").groupBy("tree", F.expr(f"place div {width}").alias("place")).agg(
            F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.expr(f"place % {width}").alias("slot"), "node"))).alias("kids"))
        runs = runs.select("tree", "place", F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.expr("transform(kids, k -> k.node)").alias("kids"))
        at = written(runs.withColumn("node", F.struct(digest(F.array_join(F.expr("transform(kids, k -> k.hash)"), "")).alias("hash"))), "level")
        levels.append(at)
        tops = tops.union(at.where("size = 1").select("tree", "node.hash"))
        most = -(-most // width)
    return levels, tops


def pushed(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, place, node, proof, and the columns of tops, of every node under the levels.

    tops(tree, ..., proof) has the proof that each tree's top begins with. From the top level on, a parent gives its
    children its own proof, to which each prepends its siblings; a level's result is written before the next needs it."""
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    above = None
    for i, level in reversed(list(enumerate(levels))):
        ended = level.where("size = 1").select("tree", "place").join(tops, "tree")
        held = ended if above is None else above.drop("node").unionByName(ended)
        each = level.drop("size", "node").join(held, ["tree", "place"])
        beside = lambda a, n: f"array_join(transform(slice(kids, {a}, {n}), k -> k.hash), '')"
        each = each.select("tree", *more, F.col("place").alias("__run"), "kids", "proof", F.posexplode("kids").alias("slot", "node"))
        siblings = F.struct(F.expr(beside("1", "slot")).alias("before"), F.expr(beside("slot + 2", "size(kids)")).alias("after"))
        each = each.select("tree", (F.col("__run") * WIDTH + F.col("slot")).alias("place"), "node", *more, F.concat(F.array(siblings), "proof").alias("proof"))
        last, above = above, written(each, "proofs") if i else each
        if last is not None and i:
            spent(last)
    return above


def manifest(docs: DataFrame, tampered: dict[str, Column] = {}, columns: tuple = COLUMNS) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and the root folded from its leaf after changes to it.

    columns: doc_id, the group, then others; a leaf is the SHA-256 of their encoded values. Per group the leaves ascend by
    doc_id (null first; ties by leaf), and every 3 consecutive nodes become one until one is left, the subroot; the
    subroots, ordered by group (null first, bytewise), likewise give the root. proof_sha256 is the digest of the siblings
    level by level, left to right. ``tampered`` has new values of columns, from which folded_root is computed with the
    original siblings; verified says whether it is the root.
    Null, empty and very long values are hashed as they are; repeated rows are leaves of their own; an empty table gives an
    empty result; other columns are ignored. Only digests, never values, are shuffled.
    """
    key, group = columns[:2]
    changed = [tampered.get(c, F.col(c)) for c in columns]
    moved = F.lit(False)
    for c, new in tampered.items():
        moved = moved | ~F.col(c).eqNullSafe(new)
    leaves = docs.select(F.col(key).alias("doc_id"), F.col(group).cast("string").alias("tree"), digest(encoded(*columns)).alias("hash"), F.when(moved, digest(encoded(*changed))).alias("changed"))
    leaves = written(leaves, "leaves")
    nodes = numbered(leaves, "tree", ["doc_id", "hash", "changed"])
    # Null is a group of its own; its name can't be that of another, which has a sign before it.
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-"))
    nodes = written(nodes.select(tree.alias("tree"), "place", "size", F.struct("hash", "doc_id", "changed").alias("node")), "nodes")
    if nodes.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    levels, tops = built(nodes)
    groups = written(tops.select("tree", F.col("hash").alias("subroot"), F.lit("roots").alias("one")), "groups")
    # '-' comes before '=', so null is first and the others follow in order of their bytes.
    over = numbered(groups, "one", ["tree"]).select(F.col("one").alias("tree"), "place", "size", F.struct(F.col("subroot").alias("hash"), F.col("tree").alias("name")).alias("node"))
    over = written(over, "over")
    upper, top = built(over)
    empty = F.expr(NONE).alias("proof")
    top = top.withColumnRenamed("hash", "root").withColumn("proof", empty)
    down = pushed(upper, top).select("node", "root", "proof") if upper else over.join(top, "tree").select("node", "root", "proof")
    roots = written(down.select(F.col("node.name").alias("tree"), F.col("node.hash").alias("subroot"), "root", "proof"), "roots")
    below = pushed(levels, roots).select("node", "subroot", "root", "proof") if levels else None
    alone = nodes.where("size = 1").join(roots, "tree").select("node", "subroot", "root", "proof")
    out = alone if below is None else below.unionByName(alone)
    out = out.withColumn("folded_root", F.when(F.col("node.changed").isNull(), F.col("node.hash")).otherwise(F.col("node.changed")))
    out = out.withColumn("folded_root", folded(F.col("folded_root")))
    proof = digest(F.array_join(F.expr("transform(proof, x -> concat(x.before, x.after))"), ""))
    return out.select("node.doc_id", F.col("node.hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
