"""ISO media containers: write samples into nested boxes, walk them and decode the sample tables."""
import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

FRAME = 576
KEY_EVERY = 10
RATE = 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """One track of 8-bit samples, frame bytes in each; every KEY_EVERY-th frame is listed as a sync sample."""
    n = len(payload) // frame
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    wide = len(payload) > 2**31

    def moov(at: int) -> bytes:
        place = full(b"co64", struct.pack(">IQ", 1, at)) if wide else full(b"stco", struct.pack(">II", 1, at))
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, frame)),
                   full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), full(b"stsz", struct.pack(">II", frame, n)), place,
                   full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * frame, 0x55C4, 0))
        return box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", stbl))))

    head = box(b"ftyp", b"isom", bytes(4), b"isom")
    size = 16 if len(payload) + 8 >= 2**32 else 8
    return head + moov(len(head) + len(moov(0)) + size) + box(b"mdat", payload)


NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def walk(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of each box, nested ones included; a damaged size ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        yield kind, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop)
        start = stop


def track(data: memoryview, boxes: dict) -> dict:
    """Codec, duration, sample sizes, places and times, and keyframe byte ranges of one track, from its tables alone.

    Counts that the file can't hold raise an error before anything is made from them: samples of one size must fit into
    the file, tables into their boxes, and runs of chunks and times end with the samples."""
    at = lambda kind, skip=4: boxes[kind][0] + skip
    many = lambda fmt, where, n: struct.unpack_from(f">{n}{fmt}", data, where)
    wide = data[boxes[b"mdhd"][0]] == 1
    rate, length = struct.unpack_from(">IQ", data, at(b"mdhd", 20)) if wide else struct.unpack_from(">II", data, at(b"mdhd", 12))
    if b"stsz" in boxes:
        same, n = struct.unpack_from(">II", data, at(b"stsz"))
        if same * n > len(data):
            raise ValueError("more samples than the file holds")
        sizes = [same] * n if same else list(many("I", at(b"stsz", 12), n))
    else:
        bits, n = struct.unpack_from(">3xBI", data, at(b"stz2"))
        raw = data[at(b"stz2", 12):]
        if n > 2 * len(raw):
            raise ValueError("more samples than the table holds")
        sizes = [(raw[i // 2] >> 4 if i % 2 == 0 else raw[i // 2] & 15) for i in range(n)] if bits == 4 else list(many("B" if bits == 8 else "H", at(b"stz2", 12), n))
    table = b"co64" if b"co64" in boxes else b"stco"
    chunks = many("Q" if table == b"co64" else "I", at(table, 8), struct.unpack_from(">I", data, at(table))[0])
    held = lambda kind, width: (boxes[kind][1] - at(kind, 8)) // width
    entries = lambda kind, width: min(struct.unpack_from(">I", data, at(kind))[0], held(kind, width))
    runs = [many("I", at(b"stsc", 8) + 12 * i, 3) for i in range(entries(b"stsc", 12))]
    places, k, run = [], 0, 0
    for c, place in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= c:
            run += 1
        for _ in range(min(runs[run][1], n - k)):
            places.append(place)
            place += sizes[k]
            k += 1
    times, now = [], 0
    for i in range(entries(b"stts", 8) if b"stts" in boxes else 0):
        count, step = many("I", at(b"stts", 8) + 8 * i, 2)
        count = min(count, n - len(times))
        times += range(now, now + count * step, step) if step else [now] * count
        now += count * step
    keys = many("I", at(b"stss", 8), struct.unpack_from(">I", data, at(b"stss"))[0]) if b"stss" in boxes else range(1, n + 1)
    return {"codec": bytes(data[at(b"stsd", 12):at(b"stsd", 16)]).decode("latin-1").strip(), "duration": length / rate if rate else 0.0, "rate": rate,
            "sizes": sizes, "places": places, "times": times[:n], "keyframes": [(places[i - 1], sizes[i - 1]) for i in keys if 0 < i <= len(places)]}


def probe(media: bytes) -> list[dict]:
    """The tracks of a container in order; tracks without sample tables are left out."""
    data, found = memoryview(media), []
    for kind, a, b in walk(data, 0, len(data)):
        if kind == b"trak":
            found.append({})
        elif found:
            found[-1].setdefault(kind, (a, b))
    needed = lambda boxes: {b"mdhd", b"stsd", b"stsc"} <= boxes.keys() and (b"stsz" in boxes or b"stz2" in boxes) and (b"stco" in boxes or b"co64" in boxes)
    return [track(data, boxes) for boxes in found if needed(boxes)]


def described(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, track, codec, duration, samples and keyframes (start, bytes) of a binary media column, one row a track.

    Containers without tracks, damaged, empty or null ones give one row with null columns; payloads are not decoded. A
    task holds one container at a time beside its batch."""
    def run(batches):
        for pdf in batches:
            rows = []
            for k, media in zip(pdf["k"], pdf["media"]):
                try:
                    tracks = probe(bytes(media)) if media is not None else []
                except (struct.error, IndexError, KeyError, ValueError):
                    tracks = []
                rows += [(k, i, t["codec"], t["duration"], len(t["sizes"]), [{"start": a, "bytes": n} for a, n in t["keyframes"]]) for i, t in enumerate(tracks)] or [(k, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["k", "track", "codec", "duration", "samples", "keyframes"]).astype({"track": "Int32", "samples": "Int64"})
    kind = df.schema[key].dataType.simpleString()
    return small_batches(df.selectExpr(f"`{key}` as k", f"`{column}` as media")).mapInPandas(run, f"k {kind}, track int, codec string, duration double, samples long, keyframes array<struct<start:long,bytes:long>>").withColumnRenamed("k", key)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each text (null: empty) as samples, read it back and describe it; one row a document, with the byte ranges of all keyframes.

    Equal texts give equal values; repeated rows, ties and empty texts (one frame of padding) are kept; an empty
    table gives an empty result; other columns are ignored. A task holds one document's bytes at a time.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                raw = (text or "").encode("utf-8")
                payload = raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))
                media = mux(payload)
                info = probe(media)[0]
                lo, hi = info["places"][0], info["places"][-1] + info["sizes"][-1]
                back = media[lo:hi]
                keys = info["keyframes"]
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                             hashlib.sha256(media).hexdigest(),
                             f"{info['codec']};{info['duration']:.3f};{len(info['sizes'])};{len(keys)};{keys[0][0]}+{keys[0][1]};{keys[-1][0]}+{keys[-1][1]}",
                             [{"start": a, "bytes": n} for a, n in keys]))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<start:long,bytes:long>>"
    names = [x.split()[0] for x in schema.split(", ")]
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, schema)
