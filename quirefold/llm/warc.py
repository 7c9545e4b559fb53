"""WARC records in ZIP archives with an index: a writer of files, and a reader that opens them where they are, parses the directories and reads ranges."""
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, shared_dir, small_batches, written

#: Repeated digests up to which their counted list is broadcast.
DIGESTS = 200_000
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def directory(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """{name: (method, data start, stored size)} from the central directory, ZIP64 fields included.

    read_at(offset, length) gives bytes, so that blobs, files and remote objects are read alike."""
    tail_at = max(0, size - 65557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20 and tail[end - 20:end - 16] == b"PK\6\7":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        count, length, start = struct.unpack_from("<QQQ", read_at(at, 56), 32)
    entries, data, p = {}, read_at(start, length), 0
    for _ in range(count):
        method, = struct.unpack_from("<H", data, p + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, p + 20)
        local, = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46:p + 46 + n_name].decode("utf-8", "replace")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            kind, n = struct.unpack_from("<HH", data, q)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", data, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        n_name, n_extra = struct.unpack("<HH", read_at(local + 26, 4))
        entries[name] = (method, local + 30 + n_name + n_extra, packed)
        p = stop + n_note
    return entries


def record(kind: str, page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")),
             ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("Content-Length", len(payload))]
    if kind == "revisit":
        heads.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    heads = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return heads, body[:int(heads["Content-Length"])]


def read_archive(read_at, size: int, pick=None):
    """(headers, payload) of each record the index lists, each read by its range; with ``pick`` of those entries alone.

    What is read besides is the end of the archive with its directory, four bytes a member, and the index."""
    entries = directory(read_at, size)
    method, start, _ = entries[MEMBER]
    if method:
        raise ValueError("archive members must be stored")
    _, at, length = entries[INDEX]
    for line in read_at(at, length).decode().splitlines():
        place = json.loads(line)
        if pick is None or pick(place):
            yield parse(zlib.decompress(read_at(start + place["offset"], place["length"]), 31))


def write_archives(records: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """(archive, size) rows of the ZIP files of stored members that are written to the shared folder, closed once they exceed ``limit`` bytes.

    A task writes files of its own names, and only those of tasks that end are listed; write the result before it is read,
    as every evaluation writes archives anew."""
    folder = f"{shared_dir(records.sparkSession)}/archives-{uuid.uuid4().hex}"

    def run(batches):
        data, index = io.BytesIO(), []
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                for name, body in ((MEMBER, data.getvalue()), (INDEX, "\n".join(index).encode())):
                    with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                        f.write(body)
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(out.getvalue())
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "size": [len(out.getvalue())]})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                raw = record(r.record_type, r.page_id, r.url, (r.html or "").encode() if r.record_type == "response" else b"", r.payload_bytes, r.payload_digest, r.refers_to)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = press.compress(raw) + press.flush()
                index.append(json.dumps({"url": r.url, "page": r.page_id, "type": r.record_type, "digest": r.payload_digest, "offset": data.tell(), "length": len(packed)}))
                data.write(packed)
                if data.tell() >= limit:
                    yield close()
                    data, index = io.BytesIO(), []
        if index:
            yield close()
    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return small_batches(records.select(*text, "url", "html", "record_type", "payload_bytes", "payload_digest")).mapInPandas(run, "archive string, size long")


def read_archives(archives: DataFrame, pick=None, a_task: int = 4) -> DataFrame:
    """One row a record of the listed archives(archive, size), ``a_task`` archives a task; with ``pick`` of the index entries it keeps.

    Files are opened where they are stored and read by ranges, so a task holds a record and an index at a time. A
    response's payload is measured and hashed anew, a revisit's comes from its headers."""
    def run(batches):
        for pdf in batches:
            for path, size in zip(pdf["archive"], pdf["size"]):
                rows = []
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    for heads, body in read_archive(lambda at, n: f.read_at(n, at), size, pick):
                        there = heads["WARC-Type"] == "response"
                        n, digest = (len(body), hashlib.sha1(body).hexdigest()) if there else (int(heads["X-Payload-Length"]), heads["WARC-Payload-Digest"][5:])
                        rows.append((heads["WARC-Record-ID"][10:-1], n, digest, heads["WARC-Type"], heads.get("WARC-Refers-To", "<urn:page:>")[10:-1], heads["WARC-Target-URI"]))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
    dealt = archives.select("archive", "size").repartition(max(1, -(-archives.count() // a_task)))
    out = small_batches(dealt).mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    number = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return out.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "url")


def warc_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write every page as a WARC record into ZIP archives in the shared folder and read them back.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response and others revisit it; repeated
    rows of that page_id are responses alike. Null html is an empty payload; an empty table gives an empty result;
    other columns are ignored. Only digests of repeated payloads are grouped, partial maxima first.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha1(html.cast("binary"))})
    keys = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    keys = written(keys, "digests")
    # Payloads stay where they are while the repeated digests are few; beyond that hot ones are dealt over shares.
    # Shorter payloads, many of them equal or empty, have no digest to meet.
    if keys.count() <= DIGESTS:
        records = base.join(F.broadcast(keys.drop("n")), "payload_digest", "left")
    else:
        long = F.col("payload_bytes") >= least
        records = meet(base.where(long), keys.drop("n"), "payload_digest", keys, how="left")
        records = records.unionByName(base.where(~long).withColumn("first", F.lit(None).cast("long")))
    revisit = F.coalesce((F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    records = records.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})
    return read_archives(written(write_archives(records), "warc"))
