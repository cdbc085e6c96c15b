"""Near-duplicate documents by SimHash classes of a wide radius, within which the whole sets of word shingles decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import connected_components
from .simhash import Links, bits_of, classes, shingle_hashes

#: Fingerprints of 128 bits: a pair at a similarity of 0.8 is expected 19.4 apart (deviation 4.1), unrelated ones 64 (5.7).
WORDS, RADIUS = 2, 30
#: Minima of a set under this many hash functions make its sketch, which saves most of the intersections within a tile.
SKETCH = 192
#: Sketches agree in a share of their bytes that is the similarity with a deviation of 0.03; this far below, pairs aren't intersected.
SLACK = 0.14


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 63, (SKETCH, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (SKETCH, 1), np.uint64)


FACTOR, MASK = _functions()


def set_of(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes; empty for a text without words."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each function's minimum of the set."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[i : i + 512] ^ MASK) * FACTOR).min(axis=1), out=least)
    return (least >> np.uint64(56) ^ least & np.uint64(255)).astype(np.uint8).tobytes()


def _set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def prints(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, key, text) -> (doc_id, key, set_id, n, fp): equal sets of shingles have one set_id, n is their size."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                parts = list(shingle_hashes((text.as_py() or "").encode(), size, 42))
                hashes = set_of(parts)
                out.append((_set_id(hashes), len(hashes), bits_of([hashes], WORDS)))
            ids, counts, fps = zip(*out) if out else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "key", "set_id", "n", "fp"])

    return docs.mapInArrow(run, "doc_id long, key string, set_id long, n long, fp array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """docs(set_id, text) -> (set_id, hashes, sketch)."""

    def run(batches):
        for batch in batches:
            found = [set_of(list(shingle_hashes((t.as_py() or "").encode(), size, 42))) for t in batch.column("text")]
            yield pa.record_batch([batch.column("set_id"), pa.array([h.tobytes() for h in found], pa.binary()), pa.array([sketch(h) for h in found], pa.binary())], names=["set_id", "hashes", "sketch"])

    return docs.mapInArrow(run, "set_id long, hashes binary, sketch binary")


def compare(hashes: list[np.ndarray], sketches: np.ndarray, first: int, threshold: float, links: Links, block: int = 32) -> None:
    """Link the pairs at or above the threshold: all of them, or rows before `first` with rows from it on."""
    n, least = len(hashes), (threshold - SLACK) * sketches.shape[1]
    for i in range(0, first or n, block):
        start = first or i
        alike = (sketches[i : min(i + block, first or n), None, :] == sketches[None, start:, :]).sum(axis=2, dtype=np.uint16)
        a, b = np.nonzero(alike >= least)
        order = np.argsort(-alike[a, b].astype(np.int32), kind="stable")
        for x, y in zip((a[order] + i).tolist(), (b[order] + start).tolist()):
            if x >= y or links.root[x] == links.root[y]:
                continue
            both = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
            if both >= threshold * (len(hashes[x]) + len(hashes[y]) - both):
                links.add(np.array([x]), np.array([y]))
                links.settle()


def set_links(docs: DataFrame, known: DataFrame, size: int, threshold: float, most: int = 2048) -> DataFrame:
    """edges(src, dst) over set_id that join all sets of a SimHash class whose similarity reaches the threshold.

    Large classes are compared in tiles of about `most` sets. A task emits a spanning star, never all pairs.
    """
    alike = classes(known.where("n > 0").select(F.col("set_id").alias("id"), "fp"), RADIUS, WORDS)
    reps = known.where("n > 0").groupBy("set_id").agg(F.min("key").alias("key"), F.first("fp").alias("fp"))
    reps = keep(reps.join(alike, "fp").select("set_id", "key", F.col("component").alias("bucket")), "sets")
    sizes = keep(reps.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "buckets")
    members = keep(reps.join(sizes, "bucket"), "members")
    # Merged at any size, so that the text moved grows in proportion to the input.
    texts = docs.join(members.select("set_id", "key").hint("merge"), "key").select("set_id", "text")
    sets = keep(sets_of(texts, size).groupBy("set_id").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch")), "hashes")
    dealt = members.select("bucket", "tiles", "set_id", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int").alias("own"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = paired.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set_id").join(sets, "set_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("set_id", "ascending")])
        ids, own = table["set_id"].to_numpy(), table["own"].to_numpy()
        hashes = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        links = Links(len(ids))
        apart = table["x"][0].as_py() != table["y"][0].as_py()
        if not apart or own[0] != own[-1]:
            compare(hashes, sketches, int((own == own[0]).sum()) if apart else 0, threshold, links)
        root = links.settle()
        moved = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"src": pa.array(ids[moved], pa.int64()), "dst": pa.array(ids[root[moved]], pa.int64())})

    return paired.groupBy("bucket", "x", "y").applyInArrow(run, "src long, dst long")


def repeats(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs(doc_id, key, text), key a digest of the text -> (doc_id, key, n, kept): what stays of each near-duplicate group.

    Groups are the components of pairs within a SimHash class whose sets of shingles have a Jaccard similarity of the threshold or more; texts
    without words are one group. The smallest (doc_id, key) of a group is kept; n counts its equal rows. Null ids are
    left out.
    """
    known = keep(prints(docs, size), "prints")
    found = connected_components(set_links(docs, known, size, threshold))
    rows = known.where("doc_id is not null").groupBy("doc_id", "key").agg(F.first("set_id").alias("set_id"), F.count(F.lit(1)).alias("rows"))
    rows = rows.join(found, rows.set_id == found.node, "left").select("doc_id", "key", F.col("rows").alias("n"), F.coalesce("component", "set_id").alias("component"))
    rows = keep(rows, "rows")
    best = keep(rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("best")), "best")
    return rows.join(best, "component").select("doc_id", "key", "n", (F.struct("doc_id", "key") == F.col("best")).alias("kept"))
