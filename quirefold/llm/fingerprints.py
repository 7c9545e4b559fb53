"""Document fingerprints: gear-hash boundaries cut texts by their content; sets of chunk digests, weighted by length, measure containment."""
import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of a chunk: the least, the usual and the most.
LEAST, USUAL, MOST = 8, 32, 128
#: Top bits of the gear hash that must be zero at a cut: more before the usual size, fewer from there on.
STRICT, LOOSE = 7, 3
#: Documents of a stretch, in order of doc_id, that one task compares with their next ones; and stretches at most.
STRETCH, STRETCHES = 500, 10_000


def gears() -> np.ndarray:
    """A random number for each byte value, by xxhash of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


def gear_hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + table[byte i] in 32 bits, so the last 32 bytes count: sums over doubled widths."""
    h = table[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):
        step = h[width:] + (h[:-width] << np.uint32(width))
        h = np.concatenate([h[:width], step])
    return h


def cuts(data: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks: the first strict place from LEAST on, from USUAL on the first loose one, at MOST in any case."""
    h = gear_hashes(data, table)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = loose[h[loose] < np.uint32(1 << (32 - STRICT))].tolist()
    loose, n, ends, at = loose.tolist(), len(data), [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST - 1)
        end = strict[i] + 1 if i < len(strict) else n
        if end >= at + USUAL:
            i = bisect_left(loose, at + USUAL - 1)
            end = min(loose[i] + 1 if i < len(loose) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(text: str, table: np.ndarray) -> dict[int, int]:
    """Length in bytes by digest of each distinct chunk."""
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, {}
    digest = xxhash.xxh64_intdigest
    for end in cuts(data, table):
        out[digest(data[at:end])] = end - at
        at = end
    return out


def told(held: dict[int, int]) -> str:
    """Base64 of the records (digest, 8 bytes; length, 1 byte) in order of the digests."""
    rows = np.zeros(len(held), dtype=[("digest", "<u8"), ("bytes", "u1")])
    rows["digest"], rows["bytes"] = list(held.keys()), list(held.values())
    return base64.b64encode(np.sort(rows, order="digest").tobytes()).decode()


def read(fingerprint: str) -> dict[int, int]:
    rows = np.frombuffer(base64.b64decode(fingerprint), dtype=[("digest", "<u8"), ("bytes", "u1")])
    return dict(zip(rows["digest"].tolist(), rows["bytes"].tolist()))


def contained(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's distinct chunks, by length, that b has; of nothing in nothing 1, in something 0."""
    if not a:
        return float(not b)
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return sum(n for d, n in few.items() if d in many) / sum(a.values())


def fingerprint(column) -> Column:
    """Fingerprint of a text column; null counts as empty, and an empty text has an empty fingerprint."""
    @F.pandas_udf("string")
    def run(batches: pd.Series) -> pd.Series:
        table = gears()
        return batches.map(lambda t: told(chunks(t or "", table)))
    return run(column)


def containment(a, b) -> Column:
    """Share of fingerprint a, by length of chunks, that fingerprint b holds; null where either is null."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([contained(read(x), read(y)) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")
    return run(a, b)


def stretches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into stretches of neighbouring doc_ids, downwards, each followed by its next document.

    Adds stretch and extra; an extra row is the document after a stretch, wherever it has its own place. The driver gets
    quantiles of doc_id, and the largest doc_id of each stretch between them, STRETCHES of each at most."""
    n = docs.count()
    parts = int(min(max(1, -(-n // STRETCH)), STRETCHES))
    bounds = docs.select(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], 10 * STRETCHES).alias("b")).first()["b"]
    if not bounds:
        # All ids are null: one stretch that its own first document follows.
        return docs.select("*", F.lit(0).alias("stretch"), F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(set(bounds)), dtype="i8"))

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(sent.value, ids.to_numpy()), len(sent.value) - 1))
    heads = docs.where("doc_id is not null").select("doc_id", stretch("doc_id").alias("stretch")).groupBy("stretch").agg(F.max("doc_id").alias("doc_id")).collect()
    heads = sorted((r["stretch"], r["doc_id"]) for r in heads)
    first = heads[0][0]
    # The stretch above ends before a head; after the last one of all comes the first.
    after = docs.sparkSession.sparkContext.broadcast({head: above for (_, head), (above, _) in zip(heads, heads[1:] + heads[:1])})

    @F.pandas_udf("int")
    def followed(ids: pd.Series) -> pd.Series:
        return pd.Series([after.value.get(i, -1) for i in ids.tolist()])
    there = F.col("doc_id").isNotNull()
    known = F.coalesce("doc_id", F.lit(0))
    own = F.struct(F.when(there, stretch(known)).otherwise(first).alias("stretch"), F.lit(0).alias("extra"))
    extra = F.struct(F.col("__after").alias("stretch"), F.lit(1).alias("extra"))
    docs = docs.withColumn("__after", F.when(there, followed(known)).otherwise(-1))
    return docs.select("doc_id", "text", F.explode(F.when(F.col("__after") >= 0, F.array(own, extra)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "p.*")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edit, and how much of the text's one they and the next document hold.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. In the edited
    text the last half, rounded down, is replaced by the first as many code points (or all) of the next document, by
    descending doc_id; after the last comes the first. Nearness is the containment of the text's fingerprint.
    Null texts count as empty; an empty text is contained in an empty one alone. Rows of one doc_id stand in order of a
    hash of their text, rows with a null doc_id after all others; a single document is next to itself; an empty table
    gives an empty result; other columns are ignored.
    Texts are shuffled once. A task streams a stretch of neighbours and holds two documents at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        table = gears()

        def rows():
            for batch in batches:
                yield from zip(batch.column("doc_id").to_pylist(), batch.column("stretch").to_pylist(), batch.column("extra").to_pylist(), batch.column("text").to_pylist())
        out, size, before = [], 0, None
        for doc_id, stretch, extra, text in rows():
            now = (doc_id, stretch, extra, text, chunks(text, table))
            # After a stretch only the first extra row is its next document.
            if before is not None and before[1] == stretch and not before[2]:
                i, _, _, old, own = before
                half = len(old) // 2
                edited = old[:len(old) - half] + text[:half]
                new = own if edited == old else chunks(edited, table)
                out.append((i, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), told(own), told(new), contained(own, new), contained(own, now[4])))
                size += len(old)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
            before = now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*((name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))))
    dealt = stretches(docs).repartition("stretch")
    order = ["stretch", "extra", F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    return small_batches(dealt.sortWithinPartitions(*order)).mapInArrow(run, schema)
