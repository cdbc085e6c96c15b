"""WARC archives: a deterministic sharded writer with revisit records, and a reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, new_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:trendloom:warc")
MANIFEST = "shard int, part int, name string, bytes long, records long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(uri: str) -> str:
    """A URI for a header line: controls, blanks and non-ASCII characters percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with regenerated headers and digests; payload None makes it a revisit of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    named = lambda i: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{i}')}>"
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", named(page_id)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _safe(url))] if url else []
    fields += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", named(refers_to)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def shard_bounds(rows: DataFrame, key: str, size: str, most: int, least_shards: int, cells: int = 4096, parts: int = 16) -> list[int]:
    """Lower bounds of shards of about `most` bytes, or of a part of all bytes that gives least_shards of them.

    They come from the sizes in equal cells of the key's range; a cell that holds more than a shard, as where outliers stretch
    the range, is parted again and again, down to a single key. The driver gets a row for each cell, and each part of a full
    one, at most. Bounds depend on the rows alone, not on how these are partitioned.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    width = (high - low) // cells + 1
    held = rows.where(F.col(key).isNotNull())
    cell = F.floor(F.try_subtract(F.col(key).cast("decimal(20,0)"), F.lit(low)) / F.lit(width)).cast("long")
    found = {low + c * width: n for c, n in held.groupBy(cell.alias("c")).agg(F.sum(size)).collect()}
    target = min(most, sum(found.values()) // least_shards + 1)
    full = {c for c, n in found.items() if n > target}
    while full and width > 1:
        bounds, was, width = sorted(full), width, -(-width // parts)
        within = held.withColumn("_of", last_bound(F.col(key), bounds)).where(F.col("_of").isNotNull() & (F.col(key).cast("decimal(20,0)") - F.col("_of") < was))
        part = F.floor((F.col(key).cast("decimal(20,0)") - F.col("_of")) / F.lit(width)).cast("long")
        split = {of + p * width: n for of, p, n in within.groupBy("_of", part.alias("p")).agg(F.sum(size)).collect()}
        found = {c: n for c, n in found.items() if c not in full} | split
        full = {c for c, n in split.items() if n > target}
    out, total = [], target
    for c, n in sorted(found.items()):
        if total >= target:
            out.append(c)
            total = 0
        total += n
    return out


def bound_table(bounds: list[int]) -> Column:
    """Bounds as one literal, whose planning doesn't grow with their number; a row a shard, so some 3 MB for 100 TB."""
    return F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")


def place_of(key: Column, bounds: list[int]) -> Column:
    """Number of the last of the sorted bounds that is at most the key, by halving; -1 below the first or for a null."""
    table = bound_table(bounds)

    def halve(acc, _):
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        up = F.get(table, middle) <= key
        return F.struct(F.when(up, middle).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(middle).alias("high"))

    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    start = F.struct(F.lit(-1).alias("low"), F.lit(len(bounds)).alias("high"))
    # Between low and high there is a middle until they are neighbours; then it is low itself, which stays below.
    step = lambda acc, i: F.when(acc["high"] - acc["low"] > 1, halve(acc, i)).otherwise(acc)
    return F.when(key.isNull(), -1).otherwise(F.aggregate(steps, start, step, lambda acc: acc["low"]))


def last_bound(key: Column, bounds: list[int]) -> Column:
    return F.get(bound_table(bounds), place_of(key, bounds))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, roll_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, least_shards: int = 64, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every page below `path` and return the manifest (shard, part, name, bytes, records, sha256).

    Of pages with equal payloads of at least least_revisit bytes, the one with the smallest id is a response, the others
    are revisits of it; further rows with that same id are responses as well. Null html is an empty payload. Records are
    range-sorted by id into shards; a shard rolls to a new file once it has roll_bytes compressed bytes. A task writes each
    file under a temporary name of its own, then renames it to its final name; a repeated task writes the same bytes, so a
    lost executor or a second attempt changes nothing. Readers follow the manifest, which is written last. Pages with a
    null id go to the first shard and are always responses. Extra columns are not written.
    """
    spark = pages.sparkSession
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("size", F.length("payload").cast("long"))
    keys = keep(rows.select("id", "size", F.sha2("payload", 256).alias("sha")), "payload_keys")
    first = keep(keys.where(F.col("size") >= least_revisit).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "size", "first"), "firsts")
    revisits = keep(keys.join(first, ["sha", "size"]).where("id <> first").select("id", "sha", "first").distinct(), "revisits")
    bounds = shard_bounds(keys, "id", "size", shard_bytes, least_shards)
    shard = F.greatest(place_of(F.col("id"), bounds), F.lit(0)).cast("int").alias("shard")
    full = rows.select(shard, "id", F.sha2("payload", 256).alias("sha"), F.lit(1).alias("kind"), "url", "size", F.lit(None).cast("long").alias("refers"), F.unhex(F.sha1("payload")).alias("sha1"), "payload")
    marks = revisits.select(shard, "id", "sha", F.lit(0).alias("kind"), F.col("first").alias("refers"))
    out = full.unionByName(marks, allowMissingColumns=True).repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", "id", "sha", "kind", "url")

    def write(batches):
        fs, top = filesystem(path)
        fs.create_dir(top, recursive=True)
        now, part, sink, mark = None, 0, None, (None, None, None)

        def close():
            nonlocal sink
            handle, temporary, name, total, n, sha = sink
            handle.close()
            fs.move(temporary, f"{top}/{name}")
            sink = None
            return now, part, name, total, n, sha.hexdigest()

        def done(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "part", "name", "bytes", "records", "sha256"])

        for batch in batches:
            for r in batch.to_pylist():
                if not r["kind"]:  # it precedes the rows it makes revisits
                    mark = r["id"], r["sha"], r["refers"]
                    continue
                refers = mark[2] if mark[:2] == (r["id"], r["sha"]) else None
                if sink and (r["shard"] != now or sink[3] >= roll_bytes):
                    yield done([close()])
                    part += 1
                if r["shard"] != now:
                    now, part = r["shard"], 0
                if not sink:
                    name = f"part-{now:06d}-{part:05d}.warc.gz"
                    temporary = f"{top}/.{name}.{uuid.uuid4().hex}"
                    sink = [fs.open_output_stream(temporary, compression=None), temporary, name, 0, 0, hashlib.sha256()]
                data = member(record(r["id"], r["url"], r["payload"] if refers is None else None, r["size"], base64.b32encode(r["sha1"]).decode(), refers, date), level)
                sink[0].write(data)
                sink[5].update(data)
                sink[3] += len(data)
                sink[4] += 1
        if sink:
            yield done([close()])

    manifest = out.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def parse(stream):
    """Records of a gzipped WARC stream: (headers, block), one at a time."""
    z, data = zlib.decompressobj(31), b""
    parts = []
    while chunk := data or stream.read(1 << 20):
        parts.append(z.decompress(chunk))
        data = z.unused_data
        if z.eof:
            raw = b"".join(parts)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def read_warc(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """Records of the manifest's files, read whole and verified: digests, lengths and record counts must agree.

    payloads: return the responses' payloads too (else null). An empty manifest gives no rows.
    """

    def rows(name, records):
        fs, top = filesystem(path)
        n = 0
        with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
            for fields, block in parse(stream):
                n += 1
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                expected = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or response and (len(payload) != size or digest(payload) != expected):
                    raise ValueError(f"{name}: record {n} does not match its digests")
                refers = fields.get("X-Refers-To-Page-ID")
                page = fields.get("X-Page-ID")
                yield page and int(page), size, expected, fields["WARC-Type"], refers and int(refers), fields.get("WARC-Target-URI"), payload if payloads and response else None
        if n != records:
            raise ValueError(f"{name}: {n} records, {records} expected")

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches):
        for batch in batches:
            for f in batch.to_pylist():
                held, size = [], 0
                for row in rows(f["name"], f["records"]):
                    held.append(row)
                    size += len(row[6] or b"") + 200
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    files = manifest.select("name", "records")
    return files.repartition(max(1, min(files.count(), 10_000)), "name").mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages, then read the archives back: a row a record."""
    path = path or new_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path, **options), path)
