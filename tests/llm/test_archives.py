"""Archives: an exact round trip, and files that don't depend on partitions or attempts."""

import base64
import gzip
import hashlib
import os

import pytest

from pyspark.sql import functions as F

from trendloom.llm import warc

PAGES = [(3, "http://a/é", "<p>one</p>", "x"), (1, "http://b", "<p>one</p>", "x"), (2, None, None, "x"), (9, "http://c", "", "x"), (7, "u\r\nX: y", "ü" * 3000, "x"), (7, "v", "ü" * 3000, "x"), (5, "http://d", "<p>two</p>", "x"), (None, "n", "<p>one</p>", "x"), (11, "http://e", "<p>one</p>", "x")]
SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows, least):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = i is not None and len(raw) >= least and i != first[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, tmp_path, least):
    rows = spark.createDataFrame(PAGES, SCHEMA)
    got = warc.archive_round_trip(rows, f"file://{tmp_path}/w", least_revisit=least)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(PAGES, least)


def test_files_are_deterministic_and_roll(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h/{i}", os.urandom(8).hex() * 50, "x") for i in range(200)], SCHEMA)
    names = []
    for k, r in enumerate((rows, rows.repartition(7))):
        m = warc.write_warc(r, f"file://{tmp_path}/{k}", shard_bytes=40_000, least_shards=1, roll_bytes=4_000)
        names.append(sorted((x["name"], x["bytes"], x["records"], x["sha256"]) for x in m.collect()))
        assert sorted(x for x in os.listdir(tmp_path / str(k)) if x.endswith(".gz") and not x.startswith(".")) == [n[0] for n in names[-1]]
    assert names[0] == names[1] and len(names[0]) > 3 and sum(n[2] for n in names[0]) == 200
    data = gzip.open(tmp_path / "0" / names[0][0][0]).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and not any(".warc.gz." in f for f in os.listdir(tmp_path / "0"))


def test_payloads_come_back(spark, tmp_path):
    rows = spark.createDataFrame(PAGES, SCHEMA)
    m = warc.write_warc(rows, f"file://{tmp_path}/w")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(m, f"file://{tmp_path}/w", payloads=True).where("payload is not null").collect()}
    assert got[1] == "<p>one</p>" and got[7] == "ü" * 3000


def test_damage_is_seen(spark, tmp_path):
    m = warc.write_warc(spark.createDataFrame(PAGES, SCHEMA), f"file://{tmp_path}/w", least_shards=1)
    name = m.first()["name"]
    records = gzip.decompress((tmp_path / "w" / name).read_bytes()).replace(b"<p>two", b"<p>TWO")
    (tmp_path / "w" / name).write_bytes(gzip.compress(records))
    with pytest.raises(Exception, match="digests|end|records"):
        warc.read_warc(m, f"file://{tmp_path}/w").collect()


def test_empty(spark, tmp_path):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w").count() == 0


def test_bounds_where_an_outlier_stretches_the_range(spark):
    ids = [*range(1000), 1 << 62, -(1 << 62), 5, 5]
    rows = spark.createDataFrame([(i, 10) for i in ids] + [(None, 10)], "id long, size long")
    bounds = warc.shard_bounds(rows, "id", "size", most=1000, least_shards=4)
    assert bounds[0] == -(1 << 62) and len(bounds) >= 8
    got = rows.select("id", warc.place_of(F.col("id"), bounds).alias("p")).collect()
    from bisect import bisect_right

    assert all(r["p"] == (bisect_right(bounds, r["id"]) - 1 if r["id"] is not None else -1) for r in got)
    sizes = [sum(1 for i in ids if bisect_right(bounds, i) - 1 == k) for k in range(len(bounds))]
    assert max(sizes) <= 210
