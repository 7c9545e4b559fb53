"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find by star contraction."""
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, meet, restricted, small_batches, spent, written

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
PARITY = 1024
LONGS = PARITY // 64
#: Bytes of a word that the table of the word hash covers; longer words are hashed whole by xxhash.
WIDTH = 32
#: Counters of shingles by which rare ones are told from frequent ones; a fixed number at any size of the input.
SLOTS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    #: Random numbers by byte and place, upper case as lower case; a word's hash is the sum of those of its bytes.
    TABLE = mix(np.arange(1, 256 * WIDTH + 1, dtype=U) * GOLD).reshape(256, WIDTH)
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
TABLE[65:91], TABLE[BLANK] = TABLE[97:123], 0


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes ``raw``, and the number of words in each text from bounds[i] to bounds[i + 1]."""
    inside = ~BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=U), np.zeros(len(bounds) - 1, dtype=np.int64)
    begin = starts[0]
    place = np.arange(len(raw) - begin, dtype=np.int32)
    place -= np.repeat(starts - begin, np.diff(starts, append=len(raw))).astype(np.int32)
    np.minimum(place, WIDTH - 1, out=place)
    place += raw[begin:].astype(np.int32) * WIDTH
    hashes = np.add.reduceat(TABLE.ravel().take(place), starts - begin)
    sizes = np.add.reduceat(inside[begin:], starts - begin, dtype=np.int32)
    hashes = mix(hashes + sizes.astype(U))
    for i in np.flatnonzero(sizes > WIDTH):
        hashes[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + sizes[i]].tobytes().lower())
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingles(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, one after another, and their numbers.

    Shorter texts are one shingle, texts without words none."""
    h, n = word_hashes(raw, bounds)
    ends = np.cumsum(n)
    starts = ends - n
    made = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), made)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    out = np.zeros(len(at), dtype=U)
    for i in range(k):
        there = at + i < ends[owner]
        step = mix(out * GOLD + h[np.minimum(at + i, max(len(h) - 1, 0))] + U(i + 1)) if len(h) else out
        out = np.where(there, step, out)
    edges = np.concatenate([[0], np.cumsum(made)])
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.bincount(owner[keep], minlength=len(n))


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int, block: int = 1 << 14) -> np.ndarray:
    """SuperMinHash values, m for each set; elements holds the sets one after another.

    Element by element, step j puts r + j at the j-th place of its random permutation; a set's steps stop once j exceeds
    the largest whole part that it holds. Elements of a block take a step together, which gives the same minima."""
    held = np.full((len(sizes), m), np.inf)
    flat, owner = held.reshape(-1), np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(elements), block):
        e, of = elements[lo:lo + block], owner[lo:lo + block]
        order = None
        for j in range(m):
            if j:
                going = held[of[0]:of[-1] + 1].max(axis=1)[of - of[0]] >= j
                if not going.any():
                    break
                if not going.all():
                    e, of = e[going], of[going]
                    order, swaps = (order[going], swaps) if order is not None else (None, swaps[going])
                if order is None:
                    order = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
                    order[np.arange(len(e)), swaps] = 0
                    order[:, 0] = swaps
            bits = mix(e + U((j + 1) * int(GOLD) % 2**64))
            r = (bits >> U(32)).astype(np.float64) / 2.0**32 + j
            k = (j + (bits & U(0xFFFFFFFF)) % U(m - j)).astype(np.int64)
            if j == 0:
                place = swaps = k
            else:
                rows = np.arange(len(e))
                place = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, j]
                order[:, j] = place
            np.minimum.at(flat, of * m + place, r)
    return held


def bands_of(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of each signature."""
    v = held.view(U).reshape(len(held), bands, rows)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=U) * GOLD), (len(held), 1))
    for i in range(rows):
        out = mix(out * GOLD + v[:, :, i])
    return out.view(np.int64)


def parities(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set one bit for each of PARITY buckets: whether it holds an odd number of elements.

    Each element that only one of two sets holds flips one bit, so at least as many elements differ as bits do."""
    slot = np.repeat(np.arange(len(sizes)) * PARITY, sizes) + (elements & U(PARITY - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=len(sizes) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sizes), LONGS)


def apart(a: str, b: str) -> str:
    """SQL for the number of bits in which two parities differ."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(LONGS))


def parts(batch: pa.RecordBatch, most: int = 1 << 19):
    """(rows, bytes, bounds) of runs of texts of about ``most`` bytes, at least one text each; null texts are empty."""
    text = batch.column("text").cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield slice(lo, hi), raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.view(np.int64)))


def signed(docs: DataFrame, k: int, bands: int, rows: int, held: int = 1 << 16) -> DataFrame:
    """doc_id, n, key of the set, and for the first text of a set its band hashes and parity; later ones may have them too.

    A task remembers ``held`` sets or so, then begins anew."""
    def run(batches):
        seen = set()
        for batch in batches:
            if len(seen) > held:
                seen.clear()
            for rows_, raw, bounds in parts(batch):
                sets, n = shingles(raw, bounds, k)
                ends = np.cumsum(n)
                keys = [hashlib.md5(sets[b - c:b].tobytes()).digest() if c else None for b, c in zip(ends.tolist(), n.tolist())]
                fresh = np.array([x is not None and not (x in seen or seen.add(x)) for x in keys], dtype=bool)
                own, count = sets[np.repeat(fresh, n)], n[fresh]
                band = np.zeros((len(n), bands), dtype=np.int64)
                band[fresh] = bands_of(signatures(own, count, bands * rows), bands, rows)
                parity = parities(own, count)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows_], pa.array(n), pa.array(keys, pa.binary()),
                                                  lists(band[fresh].ravel(), fresh * bands), lists(parity.ravel(), fresh * LONGS)], names=["doc_id", "n", "key", "bands", "parity"])
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, parity array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """rep, shingles of each row."""
    def run(batches):
        for batch in batches:
            for rows, raw, bounds in parts(batch):
                sets, n = shingles(raw, bounds, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], lists(sets, n)], names=["rep", "shingles"])
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "rep long, shingles array<long>")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each id to the smallest that these links alone reach, in place of the links a, b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    low = np.arange(len(ids))
    while (low[x] != low[y]).any():
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(ids))
    return ids[moved], ids[low[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """u, v: links that connect what links(a, b) connect, with as many as a task holds at a time (an Arrow batch) made stars."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(batch.column(c).to_numpy() for c in "ab"))], names=["u", "v"])
    return links.select("a", "b").where("a != b").mapInArrow(run, "u long, v long")


def are_stars(edges: DataFrame) -> bool:
    """Whether in edges(u, v) each u has one v, and none of these is a u."""
    ends = edges.select(F.col("u").alias("id"), "v").union(edges.select("v", F.lit(None).cast("long")))
    ids = ends.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.count("*") > F.count("v")).alias("low"))
    return not ids.agg(F.max(F.expr("lo is not null and (lo != hi or low)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for ids in links(a, b): large-star and small-star rounds until all are stars.

    Tasks first contract what they hold, which leaves few rounds or none. Each round joins every id to its smallest
    neighbour; an id with very many neighbours is dealt over shares."""
    edges = written(contracted(links).distinct(), "edges")
    while not are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = meet(both, low.drop("n"), "u", low.select("u", "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u != v").distinct()
        after = written(small, "edges")
        spent(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs(a, b) whose full sets are near enough; a text in very many pairs is dealt over shares."""
    full = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"))
    checked = meet(meet(pairs, full("a"), "a"), full("b"), "b", pairs.groupBy("b").agg(F.count("*").alias("n"))).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return written(checked.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b").distinct(), "links")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of SLOTS counters; the driver gets at most SLOTS rows."""
    def run(batches):
        held = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("shingles").flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], names=["slot", "n"])
    rows = small_batches(sets.select("shingles")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefixes(sets: DataFrame, percent: int, frequent: int = 500, listed: int = 100_000) -> DataFrame:
    """rep, shingle, first: of each set the rarest shingles, of which two near sets share one at least; written.

    Rare is by the counter of a shingle, ties by its hash: one order for all sets, as prefix filtering needs. Counters mix
    shingles, so those that a first pass finds in more than ``frequent`` prefixes, the ``listed`` most frequent of them,
    go to the end of the order in a second pass; that changes the work, and no link. Of the smaller set of a pair those
    marked first suffice, as the pair's common part is larger in relation to it. A shingle whose counter is one stands in
    one set alone and meets nothing, so it only shortens the rest."""
    spark = sets.sparkSession
    often = frequencies(sets)

    def ranked(common: np.ndarray, places: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((often, common, places))

        def run(batches):
            often, common, places = shared.value
            for batch in batches:
                ids, column = batch.column("rep").to_numpy(), batch.column("shingles")
                at = np.asarray(column.offsets)
                values = column.values.to_numpy()
                reps, found, first = [], [], []
                for rep, a, b in zip(ids, at[:-1], at[1:]):
                    s, n = values[a:b], int(b - a)
                    if not n:
                        continue
                    c = often[s & (SLOTS - 1)].astype(np.int64)
                    if len(common):
                        i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        c = np.where(common[i] == s, places[i] + (1 << 32), c)
                    rank = np.lexsort((s, c))[:n - (n * percent + 99) // 100 + 1]
                    lead = np.arange(len(rank)) < n - (n * 2 * percent + 99 + percent) // (100 + percent) + 1
                    met = c[rank] > 1
                    found.append(s[rank][met])
                    first.append(lead[met])
                    reps.append(np.full(int(met.sum()), rep))
                if reps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, found, first)], names=["rep", "shingle", "first"])
        return written(small_batches(sets.select("rep", "shingles")).mapInArrow(run, "rep long, shingle long, first boolean"), "prefixes")

    out = ranked(np.empty(0, np.int64), np.empty(0, np.int64))
    counts = out.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > frequent)
    rows = sorted(map(tuple, counts.orderBy(F.desc("n"), "shingle").limit(listed).collect()))
    if not rows:
        return out
    spent(out)
    return ranked(*(np.array(c, dtype=np.int64) for c in zip(*rows)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Equal sets form a class first; classes meet in band buckets. In the first round each meets its bucket's smallest
    doc_id; links are confirmed on full sets and joined into components. Buckets that then span several components are
    opened: the classes in them meet by their rarest shingles, in which near sets must share one, so no link within a
    bucket is lost, while texts that share a frequent passage only don't meet. Pairs of one component, of sizes too far
    apart, or with parities that prove too many differences leave before their sets are compared.
    Null, empty and blank texts have no shingles and link with nothing; repeated rows link with themselves and stay;
    rows of one doc_id with different texts share a component, found by the text of the smallest key; rows with a null
    doc_id stay with a null component, unless their text is that of another; an empty table gives an empty result; other
    columns are ignored.
    """
    table = written(signed(docs, k, bands, rows), "signed")
    classes = written(table.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    chosen = classes.where("rep is not null").groupBy("rep").agg(F.min("key").alias("key"))
    heavy = table.where("size(bands) > 0").select("key", "n", "bands", "parity")
    reps = written(heavy.join(chosen, "key").dropDuplicates(["key"]).select("rep", "n", "bands", "parity"), "members")
    light = reps.select("rep", "n", "parity")
    members = reps.select("rep", F.explode("bands").alias("band"))
    buckets = written(members.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1"), "buckets")
    sizes = buckets.select("band", F.col("size").alias("n"))
    met = written(meet(members, buckets.select("band", "lead"), "band", sizes), "met")
    pairs = written(met.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")

    def likely(pairs):
        """Those pairs whose sizes and parities allow a link."""
        side = lambda c: light.select(F.col("rep").alias(c), F.struct("n", "parity").alias(f"s{c}"))
        both = meet(meet(pairs, side("a"), "a"), side("b"), "b", pairs.groupBy("b").agg(F.count("*").alias("n")))
        return written(both.where(f"100 * least(sa.n, sb.n) >= {percent} * greatest(sa.n, sb.n) and {100 + percent} * ({apart('sa.parity', 'sb.parity')}) <= {100 - percent} * (sa.n + sb.n)").select("a", "b"), "likely")

    able = likely(pairs)
    named = written(ids_of(able), "ids")
    sets = written(shingle_sets(restricted(docs, named.withColumnRenamed("rep", "doc_id"), "doc_id"), k), "sets")
    links = confirmed(able, sets, percent)
    spent(pairs, able, named, sets)
    comp = components(links)

    placed = meet(met, buckets.select("band"), "band", sizes).join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    opened = written(meet(met, several, "band", sizes).select("rep").distinct(), "open")
    inside = light.join(opened, "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    inside = written(inside, "inside")
    if not inside.isEmpty():
        sets = written(shingle_sets(restricted(docs, opened.withColumnRenamed("rep", "doc_id"), "doc_id"), k), "sets")
        rare = prefixes(sets, percent)
        keyed = written(rare.join(inside.select("rep", "component"), "rep"), "keyed")
        mixed = written(keyed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("shingle", "n"), "mixed")
        keyed = meet(keyed, mixed.select("shingle"), "shingle", mixed).join(inside.drop("component"), "rep")
        lead = keyed.where("first").select("shingle", F.struct("rep", "n", "component", "parity").alias("lead"))
        like = f"100 * lead.n >= {percent} * n and {100 + percent} * ({apart('parity', 'lead.parity')}) <= {100 - percent} * (n + lead.n)"
        found = meet(keyed, lead, "shingle", mixed).where(f"(lead.n < n or lead.n = n and lead.rep != rep) and component != lead.component and {like}")
        more = written(found.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct(), "pairs")
        named = written(ids_of(more), "ids")
        extra = confirmed(more, restricted(sets, named, "rep"), percent)
        spent(sets, rare, mixed, more, named)
        if not extra.isEmpty():
            comp = components(comp.select(F.col("component").alias("a"), F.col("id").alias("b")).union(extra))
    spent(met, buckets, reps, opened)
    roots = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("root"))
    held = table.select("doc_id", F.col("n").alias("n_shingles"), "key")
    linked = meet(held.where("key is not null"), roots, "key", classes.select("key", F.col("size").alias("n")))
    alone = held.where("key is null").select("*", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("root"))
    root = F.coalesce("root", "doc_id")
    out = linked.select(alone.columns).union(alone)
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
