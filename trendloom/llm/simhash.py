"""SimHash near-duplicates: fingerprints of word shingles, 64 bits or a multiple, compared exactly in tiles."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import connected_components

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are hashed at once; longer texts go through in parts, all of them counted.
PART = 1 << 20


def shingle_hashes(raw: bytes, size: int, seed: int):
    """Arrays of XXH64 of every shingle of lower-cased (A-Z) words, part by part."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    at, carried, seen = 0, [], 0
    while at < len(raw):
        stop = at + PART
        if stop < len(raw):
            cut = _SPACE.search(raw, stop)
            stop = cut.start() if cut else len(raw)
        words = carried + raw[at:stop].lower().split()
        at = stop
        if len(words) < size:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        seen += len(starts)
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
        carried = words[len(words) - size + 1 :] if size > 1 else []
    if not seen and carried:
        yield np.array([digest(b" ".join(carried), seed)], np.uint64)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Further 64 bits of each hash: multiply and shift, as finalizers do."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ hashes >> np.uint64(shift)) * np.uint64(factor)
    return hashes ^ hashes >> np.uint64(31)


def bits_of(parts, words: int = 1) -> list[int]:
    """The fingerprint of arrays of shingle hashes as signed 64-bit numbers; zero without any."""
    ones, n = np.zeros((words, 64), np.int64), 0
    for hashes in parts:
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            for w in range(words):
                part = part if w == 0 else _spread(part)
                ones[w] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.int64)[:, 0].tolist() if n else [0] * words


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash; zero for a text without words."""
    return bits_of(shingle_hashes((text or "").encode(), size, seed))[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row a document, fp an array of one number. Null and empty texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            out = np.fromiter((fingerprint(t.as_py(), size, seed) for t in texts), np.int64, len(texts))
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32), out)], names=["id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp array<long>")


class Links:
    """Union of linked rows within one task; only a spanning star leaves it."""

    def __init__(self, n: int):
        self.root, self.waiting, self.held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > 500_000:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.held = [], 0
            while len(a):
                ra, rb = self.root[a], self.root[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                if not len(a):
                    break
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
                    self.root = deeper
        return self.root


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit parts: their differences add up to a distance's lower bound."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16)).astype(np.int16)


def _subtiles(fp: np.ndarray, rows: int):
    """Order of the rows by quarter counts, and each subtile's bounds of them."""
    q = _quarters(fp)
    order = np.lexsort(q.T[::-1])
    cuts = np.arange(0, len(fp), rows)
    return order, cuts, np.minimum.reduceat(q[order], cuts), np.maximum.reduceat(q[order], cuts)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, links: Links, rows: int = 256) -> None:
    """Link all pairs within the radius: rows of a against rows of b (numbered after a's), or a against itself. Rows hold a word or more."""
    oa, ca, la, ha = _subtiles(a, rows)
    ob, cb, lb, hb = (oa, ca, la, ha) if b is None else _subtiles(b, rows)
    fa, fb, shift = a[oa], (a[oa] if b is None else b[ob]), 0 if b is None else len(a)
    for i in range(len(ca)):
        gap = np.maximum(0, np.maximum(lb - ha[i], la[i] - hb)).sum(axis=1)
        x, ia = fa[ca[i] : ca[i] + rows, None, :], oa[ca[i] : ca[i] + rows]
        for j in np.nonzero(gap <= radius)[0]:
            if b is None and j < i:
                continue
            y = fb[None, cb[j] : cb[j] + rows, :]
            apart = np.bitwise_count(x[:, :, 0] ^ y[:, :, 0])
            for w in range(1, a.shape[1]):
                apart += np.bitwise_count(x[:, :, w] ^ y[:, :, w])  # up to 255 bits
            near = apart <= radius
            if near.any():
                r, c = np.nonzero(near)
                links.add(ia[r], ob[cb[j] + c] + shift)


def near_links(reps: DataFrame, radius: int = 4, words: int = 1, least_rows: int = 1024, most_rows: int = 1 << 18) -> DataFrame:
    """reps(fp, rep), distinct fp of so many words (three at most) -> edges(src, dst) over rep that join whatever lies within the radius.

    Rows are dealt to tiles by population count and a hash, so that no tile is larger than about most_rows; tiles whose
    counts differ beyond the radius never meet. A task compares two tiles exactly and emits a spanning star of what it
    linked, never all pairs.
    """
    spark = reps.sparkSession
    bits = 64 * words
    pop = F.aggregate("fp", F.lit(0), lambda acc, x: acc + F.bit_count(x))
    counts = {r[0]: r[1] for r in reps.groupBy(pop.alias("p")).count().collect()}  # a row for each number of bits at most
    rows = min(most_rows, max(least_rows, sum(counts.values()) // 64))
    slots = [-(-counts.get(p, 0) // rows) for p in range(bits + 1)]
    spark_slots = F.array(*[F.lit(n) for n in slots])
    tiles = (
        reps.select("fp", "rep", pop.alias("p"))
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.greatest(F.get(spark_slots, F.col("p")), F.lit(1))).cast("int"))
        .groupBy("p", "s").agg(F.flatten(F.collect_list("fp")).alias("fps"), F.collect_list("rep").alias("reps"))
    )

    def with_tiles(low, high):
        return F.flatten(F.transform(F.sequence(low, high), lambda q: F.when(F.get(spark_slots, q) > 0, F.transform(F.sequence(F.lit(0), F.get(spark_slots, q) - 1), lambda t: F.struct(q.alias("q"), t.alias("t")))).otherwise(F.array().cast("array<struct<q:int,t:int>>"))))

    code = lambda p, s: p.cast("long") * (1 << 32) + s
    own = code(F.col("p"), F.col("s"))
    other = code(F.col("o.q"), F.col("o.t"))
    paired = (
        tiles.select("*", F.explode(with_tiles(F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(bits)))).alias("o"))
        .select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), own.alias("own"), "fps", "reps")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("own")
        fps = [np.asarray(v.values, dtype=np.int64).view(np.uint64).reshape(-1, words) for v in table["fps"]]
        ids = np.concatenate([np.asarray(v.values, dtype=np.int64) for v in table["reps"]])
        if table["x"][0].as_py() != table["y"][0].as_py() and len(fps) < 2:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        links = Links(len(ids))
        compare(fps[0], fps[1] if len(fps) > 1 else None, radius, links)
        root = links.settle()
        moved = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"src": ids[moved], "dst": ids[root[moved]]})

    return paired.groupBy("x", "y").applyInArrow(run, "src long, dst long")


def classes(prints: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """prints(id, fp) -> (fp, component): the smallest id that links within the radius reach from each fingerprint.

    Equal fingerprints are merged before comparison, so groups of copies cost one row. Null ids have no component of their own.
    """
    reps = keep(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "reps")
    found = connected_components(near_links(reps, radius, words))
    return keep(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id_col, fingerprint, component_id): each document with its SimHash and the smallest id that links reach.

    Null and empty texts share fingerprint zero and link like any others. Repeated rows stay repeated. A null id gets its
    fingerprint and the component of the documents with an equal one (null if there are none). Other columns of docs are
    not read. Equal fingerprints are merged before comparison, so groups of copies cost one row.
    """
    prints = keep(fingerprints(docs, id_col, text_col, size, seed), "simhash")
    known = classes(prints, radius)
    number = F.get("fp", F.lit(0))
    return prints.join(known, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex(number), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
