"""Packing of token pieces into sequences: a plan over length counts, improved by swaps, then dealt out by rank."""
import os
import re
import sys
import types
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written


#: The pattern by which the byte-level model cuts text, for characters on which Python's classes agree with it.
CUT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: White space of Unicode below U+2100.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]


def agreed(c: str) -> bool:
    """Whether Python's classes put a character where the model's do: letters, numbers, white space or the rest."""
    kind, there = unicodedata.category(c), [bool(re.match(x, c)) for x in (r"[^\W\d_]", r"\d", r"\s")]
    return there == [kind[0] == "L", kind[0] == "N", ord(c) in SPACES] and kind != "Cn"


def unusual() -> re.Pattern:
    """Characters on which they don't agree, and all from U+2100 on, whose classes may depend on the Unicode version."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x2100) if not agreed(chr(c))) + "\u2100-\U0010ffff]")


def byte_signs() -> str:
    """By byte the sign under which a byte-level vocabulary keeps it: printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class Words(dict):
    """Numbers of words in order of their first appearance; new ones are also kept in ``new``."""

    def __init__(self):
        self.new = []

    def __missing__(self, word):
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Coder:
    """Ids of texts by the tokenizer, each distinct word between its cuts coded once.

    A byte-level model never merges across its cuts, so a text's ids are those of its words in a row. Blocks with unusual
    characters go to the tokenizer as they are. Blocks end before a space between two letters or digits, where the model
    always cuts. A text that holds an added token of the model, as one that ends texts, goes to the tokenizer whole, which
    gives the token's own id; with ``as_text`` such tokens are coded like other text. Beyond ``most`` held words all are
    forgotten, so memory stays bounded."""

    def __init__(self, vocabulary: str, most: int = 600_000, block: int = 1 << 16, as_text: bool = False):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(vocabulary)
        self.model.encode_special_tokens = as_text
        added = sorted(t.content for t in self.model.get_added_tokens_decoder().values() if not (as_text and t.special))
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.most, self.block, self.unusual, self.signs = most, block, unusual(), byte_signs()
        self.forget()

    def forget(self):
        self.known, self.used = Words(), 0
        self.starts, self.sizes, self.ids = np.empty(1 << 14, "i8"), np.empty(1 << 14, "i8"), np.empty(1 << 16, "<u4")

    def blocks(self, text: str):
        lo = 0
        while len(text) - lo > self.block:
            cut = SAFE_CUT.search(text, lo + self.block)
            if cut is None:
                break
            yield text[lo:cut.start()]
            lo = cut.start()
        yield text[lo:]

    def learn(self):
        """Code the new words."""
        code = self.model.model.tokenize
        found = [[t.id for t in code(w.encode().decode("latin-1").translate(self.signs))] for w in self.known.new]
        sizes = np.fromiter(map(len, found), "i8", len(found))
        at, end = len(self.known) - len(found), self.used + int(sizes.sum())
        while len(self.known) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.starts[at:len(self.known)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at:len(self.known)] = sizes
        self.ids[self.used:end] = [i for x in found for i in x]
        self.used = end
        self.known.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > self.most:
            self.forget()
        out = [[] for _ in texts]
        at, counts, places = [], [], []
        number = self.known.__getitem__
        for i, text in enumerate(texts):
            if self.added is not None and self.added.search(text):
                out[i].append(np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            for block in self.blocks(text):
                if self.unusual.search(block):
                    out[i].append(np.array(self.model.encode(block, add_special_tokens=False).ids, "<u4"))
                else:
                    words = CUT.findall(block)
                    at.append(np.fromiter(map(number, words), "i8", len(words)))
                    places.append((i, len(out[i])))
                    out[i].append(None)
        if self.known.new:
            self.learn()
        if at:
            counts = np.cumsum([len(x) for x in at])
            at = np.concatenate(at)
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            ends = np.append(0, ends)
            for (i, j), lo, hi in zip(places, np.append(0, counts[:-1]), counts):
                out[i][j] = ids[ends[lo]:ends[hi]]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def coder(vocabulary: str, as_text: bool) -> Coder:
    """One for each Python worker, so that words stay known from task to task.

    It is kept in a module of the worker's own, as this one travels with the job and begins anew with each task."""
    worker = sys.modules.setdefault("__quirefold_worker__", types.ModuleType("__quirefold_worker__"))
    held, key = vars(worker).setdefault("coders", {}), (vocabulary, as_text)
    if key not in held:
        held.clear()
        held[key] = Coder(vocabulary, as_text=as_text)
    return held[key]


def runs(sizes: np.ndarray, most: int = 1 << 20):
    """(from, to) of neighbours with about ``most`` in all, one at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def pieces(docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, with_ids: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces; only longer ones are cut."""
    def run(batches):
        code = coder(vocabulary, as_text)
        end = np.array([end_id], "<u4")
        for batch in batches:
            column = batch.column("text")
            for lo, hi in runs(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)):
                rows = []
                texts = [x or "" for x in column.slice(lo, hi - lo).to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), code.encode(texts)):
                    ids = np.append(ids, end)
                    first = len(ids) % room or room
                    for k, (a, b) in enumerate(zip([0, *range(first, len(ids), room)], range(first, len(ids) + 1, room))):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b]), *([ids[a:b].tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def greedy(counts: dict[int, int], room: int) -> list[list]:
    """[pattern, copies]: best fit over the counts of lengths, as many copies at once as the counts allow."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    plan = []
    while lengths:
        pattern, gap = Counter(), room
        while (i := bisect_right(lengths, gap) - 1) >= 0:
            x = lengths[i]
            while i >= 0 and left[lengths[i]] <= pattern[lengths[i]]:
                i -= 1
            if i < 0:
                break
            x = lengths[i]
            fits = min(gap // x, left[x] - pattern[x])
            pattern[x] += fits
            gap -= x * fits
        copies = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * copies
            if not left[x]:
                del left[x]
                lengths.remove(x)
        plan.append([dict(pattern), copies])
    return plan


def exchange(a: Counter, b: Counter, room: int):
    """The move, one-for-one or two-for-one exchange that fills the fuller bin a from b most, as (out of a, into a), or None.

    Bins are counts of lengths, of which a bin of 1024 holds at most 44 different ones."""
    gap = room - sum(x * n for x, n in a.items())
    ones = sorted(b)
    offers = sorted([(y, (y,)) for y in ones] + [(y + z, (y, z)) for i, y in enumerate(ones) for z in ones[i:] if y != z or b[y] > 1])
    sums = [s for s, _ in offers]
    best, found = 0, None
    for x in (0, *a):
        i = bisect_right(sums, gap + x) - 1
        while i >= 0 and sums[i] - x > best:
            if x or len(offers[i][1]) == 1:
                best, found = sums[i] - x, ((x,) if x else (), offers[i][1])
                break
            i -= 1
    return found


def improve(plan: list[list], room: int) -> list[list]:
    """Local search over underfull bins of like pattern: exchanges raise the squared fill until bins empty.

    It ends at the lower bound of bins, or where no exchange between any two patterns raises the squared fill. Work goes
    with the number of patterns, which the room bounds, and not with that of pieces: copies of a pattern change together.
    """
    fill = lambda p: sum(x * n for x, n in p.items())
    key = lambda p: tuple(sorted(p.items()))
    whole = [p for p in plan if fill(p[0]) == room]
    bins = Counter()
    for pattern, copies in plan:
        if fill(pattern) < room:
            bins[key(pattern)] += copies
    used = sum(m for _, m in whole) + sum(bins.values())
    bound = -(-sum(fill(p) * m for p, m in plan) // room)
    size = {p: fill(dict(p)) for p in bins}
    done: dict[tuple, set] = {}
    order = sorted((n, p) for p, n in size.items())
    while used > bound:
        change = None
        for low, b in order:
            tried = done.setdefault(b, set())
            for high, a in reversed(order):
                if high < low:
                    break
                if a in tried or a == b and bins[a] < 2:
                    continue
                if (change := exchange(Counter(dict(a)), Counter(dict(b)), room)) is not None:
                    break
                tried.add(a)
            if change is not None:
                break
        if change is None:
            break
        m = bins[a] // 2 if a == b else min(bins[a], bins[b])
        out, into = change
        for old in (a, b):
            bins[old] -= m
            if not bins[old] and old in size:
                del bins[old]
                done.pop(old, None)
                order.remove((size.pop(old), old))
        full, rest = Counter(dict(a)) - Counter(out) + Counter(into), Counter(dict(b)) - Counter(into) + Counter(out)
        if not rest:
            used -= m
        for new in (full, rest):
            if fill(new) == room:
                whole.append([dict(new), m])
            elif new:
                if (p := key(new)) not in size:
                    size[p] = fill(new)
                    insort(order, (size[p], p))
                    done.setdefault(p, set())
                bins[p] += m
    return whole + [[dict(p), n] for p, n in bins.items() if n]


def slots(plan: list[list]) -> dict[int, tuple]:
    """{length: arrays of (first rank, first sequence, places a sequence, offset)} in order of rank."""
    out, used, sequence = {}, Counter(), 0
    for pattern, copies in plan:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            out.setdefault(x, []).append((used[x], sequence, n, offset))
            used[x] += n * copies
            offset += x * n
        sequence += copies
    return {x: tuple(np.array(c, dtype="i8") for c in zip(*rows)) for x, rows in out.items()}


def pack(found: DataFrame, room: int = 1024, rows_a_deal: int = 1_000_000, spread: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces; found must be a written table, as it is read three times.

    The plan works on counts of lengths, at most ``room`` of them, so neither the driver nor a task holds the pieces.
    Pieces of one length are ranked in shares of about ``rows_a_deal``, and in as many of ``spread`` shares as its part
    of all pieces, so a length that a third of the pieces have is split; the driver gets one row a share.
    """
    spark = found.sparkSession
    by = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    total = sum(by.values())
    shares = [max(1, -(-by.get(x, 0) // rows_a_deal), -(-spread * by.get(x, 0) // max(total, 1))) for x in range(1, room + 1)]
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.lit(shares), F.col("length").cast("int"))))
    first, used = {}, Counter()
    for r in sorted(dealt.groupBy("length", "deal").count().collect()):
        first[r["length"], r["deal"]] = used[r["length"]]
        used[r["length"]] += r["count"]
    plan = spark.sparkContext.broadcast((first, slots(improve(greedy(by, room), room))))

    def run(batches):
        starts, table = plan.value
        for pdf in batches:
            x = pdf["length"].to_numpy()
            rank = pdf["rank"].to_numpy() + np.array([starts[k] for k in zip(x.tolist(), pdf["deal"].tolist())], dtype="i8")
            sequence, offset = np.empty(len(pdf), "i8"), np.empty(len(pdf), "i8")
            for length in np.unique(x):
                at = np.flatnonzero(x == length)
                lo, seq, n, off = table[int(length)]
                i = np.searchsorted(lo, rank[at], side="right") - 1
                inside = rank[at] - lo[i]
                sequence[at], offset[at] = seq[i] + inside // n[i], off[i] + inside % n[i] * length
            pdf = pdf.drop(columns=["deal", "rank"])
            pdf["sequence_id"], pdf["offset"] = sequence, offset
            yield pdf.astype({"doc_id": "Int64"})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    order = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    return small_batches(dealt.withColumn("rank", F.row_number().over(order) - 1)).mapInPandas(run, f"{kinds}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, vocabulary: str, room: int = 1024, as_text: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``room`` tokens; one row a piece.

    Added tokens of the vocabulary that a text holds get their own ids, unless ``as_text`` has them coded like other text.
    Null and empty texts are one end token; repeated rows and ties are pieces of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    return pack(written(pieces(docs, vocabulary, room, as_text=as_text), "pieces"), room)
