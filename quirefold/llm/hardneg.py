"""Hard negatives by dual-tree search: trees over anchors and rows, node pairs pruned by their inner-product intervals, leaf pairs scored exactly."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, small_batches, spent, written

#: Label groups of the trees' roots, and levels of splits below them at most; their product bounds the nodes at any size of the input.
GROUPS, LEVELS = 16, 7
#: Rows that a leaf aims at, and that a block of a leaf holds about; larger leaves are dealt over blocks.
LEAF = 4096
#: Rows that the splits and centres are fitted on; every row is then placed.
SAMPLE = 16_384
#: Anchors that share a copy of a block; more are dealt over copies.
ANCHORS = 200_000
#: Components from which scores may not fit a long.
LARGE = 1 << 25


def quantised(embeddings: DataFrame) -> DataFrame:
    """Distinct rows (vec_id, label, q) that take part, q = floor(256 * x); a vec_id divisible by 7 has the next label."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    df = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    df = df.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), whole.alias("q"))
    too = F.exists("q", lambda x: F.abs(x) >= LARGE)
    return df.select("vec_id", "label", F.when(too, F.raise_error(F.lit("components are too large for exact scores"))).otherwise(F.col("q").cast("array<int>")).alias("q")).distinct()


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit(x: np.ndarray, labels: np.ndarray, depth: int) -> tuple[list, list, list]:
    """(ways, cuts, centres): splits in heap order, level by level, and for each label group and node a centre."""
    ways, cuts, centres = [], [], []
    at, group = np.zeros(len(x), "i8"), labels % GROUPS
    for level in range(depth + 1):
        centre = np.repeat(centres[-1], 2, axis=1) if level else np.zeros((GROUPS, 1, x.shape[1]))
        for g, k in {*zip(group.tolist(), at.tolist())}:
            centre[g, k] = x[(group == g) & (at == k)].mean(axis=0)
        centres.append(centre)
        if level == depth:
            return ways, cuts, centres
        way, cut = np.zeros((1 << level, x.shape[1])), np.zeros(1 << level)
        for k in range(1 << level):
            own = x[at == k]
            if len(own):
                far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                way[k] = own[((own - far) ** 2).sum(axis=1).argmax()] - far
                cut[k] = np.median(own @ way[k])
        ways.append(way)
        cuts.append(cut)
        at = 2 * at + ((x * way[at]).sum(axis=1) >= cut[at])


def place(tree: tuple, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each row, and its distances to the centres of the nodes on its way."""
    ways, cuts, centres = tree
    at, group = np.zeros(len(x), "i8"), labels % GROUPS
    apart = np.empty((len(x), len(centres)))
    for level, centre in enumerate(centres):
        apart[:, level] = np.sqrt(((x - centre[group, at]) ** 2).sum(axis=1))
        if level < len(ways):
            at = 2 * at + ((x * ways[level][at]).sum(axis=1) >= cuts[level][at])
    return at, apart


def placed(rows: DataFrame, tree: tuple, dim: int) -> DataFrame:
    """rows(.., label, q) with node (label group and leaf) and apart."""
    told, depth = rows.sparkSession.sparkContext.broadcast(tree), len(tree[0])

    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            at, apart = place(told.value, matrix(batch.column("q"), dim), labels)
            lists = pa.ListArray.from_arrays(np.arange(0, apart.size + 1, apart.shape[1], dtype="i4"), pa.array(apart.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((labels % GROUPS << depth) + at), lists], names=[*batch.schema.names, "node", "apart"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return small_batches(rows).mapInArrow(run, f"{kinds}, node long, apart array<double>")


def levels(df: DataFrame, depth: int, **more) -> list[dict]:
    """By level, arrays over its nodes: n, radius (a bit more than the largest distance), and what ``more`` aggregates."""
    each = df.select("*", F.posexplode("apart").alias("level", "far")).withColumn("prefix", F.expr(f"shiftright(node, {depth} - level)"))
    rows = each.groupBy("level", "prefix").agg(F.count("*").alias("n"), F.max("far").alias("radius"), *(c.alias(k) for k, c in more.items())).collect()
    out = []
    for level in range(depth + 1):
        own = [r for r in rows if r["level"] == level]
        at = [r["prefix"] for r in own]
        found = {k: np.zeros(GROUPS << level) for k in ("n", "radius", *more)}
        for k, v in found.items():
            v[at] = [r[k] for r in own]
        found["radius"] = found["radius"] * (1 + 1e-9) + 1e-6
        out.append(found)
    return out


def reach(centres_a, radius_a, centres_b, radius_b):
    """(least, most) inner products that rows of two nodes can have, by their balls."""
    dot = centres_a @ centres_b.T
    na, nb = (np.sqrt((c**2).sum(axis=1)) for c in (centres_a, centres_b))
    slack = np.outer(na, radius_b) + np.outer(radius_a, nb) + np.outer(radius_a, radius_b) + 1e-3
    return dot - slack, dot + slack


def fits(same: bool, low, high, label_low, label_high):
    """Which pairs of nodes can hold rows of the same label, or of different ones."""
    if same:
        return (low[:, None] <= label_high) & (high[:, None] >= label_low)
    return ~((low[:, None] == high[:, None]) & (label_low == label_high) & (low[:, None] == label_low))


def traversed(tree: tuple, anchors: list[dict], rows: list[dict], same: bool) -> np.ndarray:
    """Pairs of leaves (anchors by rows) that are left: both trees are gone down together, and a pruned pair takes all pairs below it along."""
    alive = np.ones((GROUPS, GROUPS), dtype=bool)
    for level, (a, b) in enumerate(zip(anchors, rows)):
        if level:
            alive = np.repeat(np.repeat(alive, 2, axis=0), 2, axis=1)
        centres = tree[2][level].reshape(GROUPS << level, -1)
        least, most = reach(centres, a["radius"], centres, b["radius"])
        alive &= (a["n"][:, None] > 0) & (b["n"] > 0) & fits(same, a["label_low"], a["label_high"], b["label_low"], b["label_high"])
        alive &= (most >= a["low"][:, None]) & (least <= a["high"][:, None])
    return alive


def spread(anchors: DataFrame, tree: tuple, nodes: dict, blocks: np.ndarray, same: bool, first: int, alive: np.ndarray | None, dim: int) -> DataFrame:
    """A row of anchors for each block to score it against.

    Without ``alive`` these are the ``first`` nodes with the best prospects; with it all other nodes of the pairs left that
    the anchor's own interval allows as well."""
    told = anchors.sparkSession.sparkContext.broadcast((tree[2][-1].reshape(len(blocks), -1), nodes, blocks, alive))

    def run(batches):
        centres, nodes, blocks, alive = told.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, labels = matrix(part.column("q"), dim), part.column("label").to_numpy().astype("f8")
                lows, highs = (part.column(c).to_pylist() for c in ("lows", "highs"))
                top = np.array([max(h) for h in highs], "f8")
                least, most = reach(x, np.zeros(len(x)), centres, nodes["radius"])
                able = (nodes["n"] > 0) & fits(same, labels, labels, nodes["label_low"], nodes["label_high"])
                near = np.where(able, -np.abs(x @ centres.T - np.minimum(top, 1e15)[:, None]), -np.inf)
                early = np.zeros_like(able)
                order = np.argsort(-near, axis=1, kind="stable")[:, :first]
                early[np.arange(len(x))[:, None], order] = True
                early &= able
                if alive is None:
                    going = early
                else:
                    some = np.zeros_like(able)
                    for i, (a, b) in enumerate(zip(lows, highs)):
                        for low, high in zip(a, b):
                            some[i] |= (most[i] >= low) & (least[i] <= high)
                    going = able & ~early & some & alive[part.column("node").to_numpy()]
                at, node = np.nonzero(going)
                times = blocks[node]
                at, node = np.repeat(at, times), np.repeat(node, times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(block), *(took.column(c) for c in ("key", "label", "q", "lows", "highs"))], names=["node", "block", "key", "label", "q", "lows", "highs"])
    return small_batches(anchors.select("node", "key", "label", "q", "lows", "highs")).mapInArrow(run, "node long, block long, key string, label long, q array<int>, lows array<long>, highs array<long>")


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if len(a) and len(c) and np.abs(a).max() * np.abs(c).max() * a.shape[1] >= 2.0**53:
        return a.astype("i8") @ c.astype("i8").T
    return (a @ c.T).astype("i8")


def best(scores, ids, window_low, window_high, k):
    """(row, column, score) of the k best of each row inside its window; ids break ties and must ascend along the columns."""
    inside = (scores >= window_low[:, None]) & (scores <= window_high[:, None])
    row, column = np.nonzero(inside)
    s = scores[row, column]
    order = np.lexsort((column, -s, row))
    row, column, s = row[order], column[order], s[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k], s[rank < k]


def leaf_scores(both: DataFrame, same: bool, k: int, dim: int) -> DataFrame:
    """key, w (number of the window), score, vec_id, own of the k best rows of each block for each anchor sent to it.

    ``both`` is sorted by block, a block's rows before its anchors, so a task holds one block and streams the anchors."""
    def run(batches):
        place, x, ids, labels, parts = None, None, None, None, []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("node", "block", "share", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1), len(where)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                here, kind, part = tuple(where[lo, :3]), where[lo, 3], batch.slice(lo, hi - lo)
                if here != place:
                    place, x, parts = here, None, []
                q, own_labels = matrix(part.column("q"), dim), part.column("label").to_numpy()
                if kind == 0:
                    parts.append((q, part.column("id").to_numpy(), own_labels))
                    x = None
                    continue
                if not parts:
                    continue
                if x is None:
                    x, ids, labels = (np.concatenate(c) for c in zip(*parts))
                    order = np.argsort(ids, kind="stable")
                    x, ids, labels = x[order], ids[order], labels[order]
                    parts, norms = [(x, ids, labels)], products_of_rows(x)
                lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                for a in range(0, len(q), 256):
                    scores = products(q[a:a + 256], x)
                    allowed = (own_labels[a:a + 256, None] == labels) == same
                    scores = np.where(allowed, scores, np.iinfo("i8").min)
                    mine = products_of_rows(q[a:a + 256])
                    for w in range(max(map(len, lows[a:a + 256]))):
                        low = np.array([z[w] if w < len(z) else 1 for z in lows[a:a + 256]], "i8")
                        high = np.array([z[w] if w < len(z) else 0 for z in highs[a:a + 256]], "i8")
                        row, column, s = best(scores, ids, np.maximum(low, np.iinfo("i8").min + 1), high, k)
                        if len(row):
                            own = (s == mine[row]) & (norms[column] == mine[row])
                            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row + a)), pa.array(np.full(len(row), w, "i4")), pa.array(s), pa.array(ids[column]), pa.array(own)], names=["key", "w", "score", "vec_id", "own"])
    return small_batches(both).mapInArrow(run, "key string, w int, score long, vec_id long, own boolean")


def products_of_rows(x: np.ndarray) -> np.ndarray:
    return (x.astype("i8") ** 2).sum(axis=1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id", "own")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, rows: DataFrame, tree: tuple, index: list[dict], same: bool, k: int, dim: int, first: int = 2) -> DataFrame:
    """The k best rows for each anchor and window, of the anchor's label or of others: key, w, score, vec_id, own, rank; written.

    anchors(key, label, q, node, apart, lows, highs) is a written table, so is rows(vec_id, label, q, node). A first round
    scores the nodes of the best prospects; the k-th scores found there are the windows' new lower ends, with which the
    trees are gone down, and a second round scores what is left."""
    blocks = np.maximum(1, -(-index[-1]["n"] // LEAF)).astype("i8")
    shares = max(1, -(-anchors.count() // ANCHORS))
    pick = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(blocks.tolist()), F.col("node").cast("int") + 1))
    none, no_list = F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<long>")
    side = rows.select("node", pick.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), none, "label", "q", no_list.alias("lows"), no_list.alias("highs"))

    def scored(asked: DataFrame, alive, name: str) -> DataFrame:
        sent = spread(asked, tree, index[-1], blocks, same, first, alive, dim)
        sent = sent.select("node", "block", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), "key", "label", "q", "lows", "highs")
        both = side.union(sent).repartition("node", "block", "share").sortWithinPartitions("node", "block", "share", "kind")
        return written(ranked(leaf_scores(both, same, k, dim), k), name)

    early = scored(anchors, None, "early")
    ends = early.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    raised = F.expr("transform(lows, (x, w) -> greatest(x, coalesce(kth[w], x)))")
    asked = written(anchors.join(ends, "key", "left").withColumn("lows", raised).drop("kth"), "asked")
    groups = levels(asked, len(index) - 1, label_low=F.min("label"), label_high=F.max("label"), low=F.min(F.array_min("lows")), high=F.max(F.array_max("highs")))
    late = scored(asked, traversed(tree, groups, index, same), "late")
    out = written(ranked(early.drop("rank").union(late.drop("rank")), k), "best")
    spent(early, asked, late)
    return out


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; an anchor's positives are the ``positives`` best other rows of
    its label, and each positive's negatives the ``negatives`` best rows of other labels with ``percent`` to 100 per cent of
    its score. Scores are exact integers, ties go by vec_id.
    Rows with a null vec_id, label, vector or component, or a component that isn't finite, take no part. Vectors of
    different lengths count as padded with zeros. Equal rows count once; rows of one vec_id with different labels or
    vectors are rows of their own. Positives below zero have no negatives; anchors without positives or negatives give no
    row; an empty table gives an empty result; other columns are ignored; components from 2**17 on raise an error.
    Of rows with the same label and vector only as many can be among the best as are asked for, so the smallest vec_ids
    of each stand for all in the search, and anchors of one label and vector are searched for once.
    """
    spark = embeddings.sparkSession
    points = written(quantised(embeddings), "points")
    total, dim = points.agg(F.count("*"), F.max(F.size("q"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    sample = points.select("label", "q").orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).toArrow()
    depth = int(np.clip(np.ceil(np.log2(max(1, total / LEAF))), 0, LEVELS))
    tree = fit(matrix(sample.column("q"), dim), sample.column("label").to_numpy(), depth)
    first = Window.partitionBy("label", "q").orderBy("vec_id")
    rows = points.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max(positives + 1, negatives)).drop("__n")
    rows = written(placed(rows, tree, dim), "rows")
    index = levels(rows, depth, label_low=F.min("label"), label_high=F.max("label"))

    key = F.md5(F.concat_ws(",", "label", F.array_join("q", ","))).alias("key")
    members = written(points.where(F.col("vec_id") % every == 0).select("vec_id", "label", "q", key), "anchors")
    alike = placed(members.groupBy("key").agg(F.first("label").alias("label"), F.first("q").alias("q")), tree, dim)
    ends = lambda x: F.array(F.lit(x).cast("long"))
    alike = written(alike.select("*", ends(-(2**62)).alias("lows"), ends(2**62).alias("highs")), "alike")
    found = search(alike, rows, tree, index, True, positives + 1, dim)
    wanted = found.where("score >= 0").groupBy("key").agg(F.array_sort(F.collect_set("score")).alias("highs"))
    asked = alike.drop("lows", "highs").join(wanted, "key").withColumn("lows", F.expr(f"transform(highs, x -> (x * {percent} + 99) div 100)"))
    asked = written(asked, "asked")
    against = search(asked, rows, tree, index, False, negatives, dim)

    scored = against.join(asked.select("key", "highs"), "key").withColumn("positive_score", F.expr("highs[w]"))
    scored = scored.groupBy("key", "positive_score").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("negatives"))
    chosen = found.select("key", F.col("score").alias("positive_score"), F.struct(F.col("rank").alias("place"), F.col("vec_id").alias("id"), "own").alias("positive"))
    whole = chosen.groupBy("key").agg(F.array_sort(F.collect_list("positive")).alias("all"))
    answers = chosen.join(scored, ["key", "positive_score"]).join(whole, "key")
    answers = written(answers.groupBy("key").agg(F.collect_list(F.struct("positive", "all", "positive_score", "negatives")).alias("answers")), "answers")
    out = meet(members.select("vec_id", "key"), answers, "key").select(F.col("vec_id").alias("anchor_id"), F.explode("answers").alias("a"))
    # An anchor's own row is none of its positives; where it isn't listed, the last of the list is one too many.
    listed = F.exists("a.all", lambda x: x["own"] & (x["id"] == F.col("anchor_id")))
    own = F.col("a.positive.own") & (F.col("a.positive.id") == F.col("anchor_id"))
    out = out.where(~own & (listed | (F.col("a.positive.place") <= positives)))
    out = out.select("anchor_id", F.col("a.positive.id").alias("positive_id"), "a.positive_score", F.explode("a.negatives").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
