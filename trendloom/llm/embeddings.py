"""Embedding near-duplicates: spherical-cap filters from structured random product codes, joined and verified."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import connected_components
from .simhash import Links

BLOCKS = 2
#: Vectors of fewer dimensions all meet in one filter, whose tiles are compared exactly: blocks of one or two coordinates have few
#: directions, so that caps that find the pairs hold a large part of everything.
EXACT_BELOW = 6
#: Code words for each block up to this many distinct vectors; twice as many for each four times as many vectors, so that filters don't fill.
WORDS, WORDS_FOR = 64, 1_000_000


def product_code(dim: int, words: int, seed: int):
    """A random rotation and, for each block of coordinates, its random unit code words."""
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    cuts = [dim * i // BLOCKS for i in range(BLOCKS + 1)]
    code = [rng.normal(size=(words, max(1, b - a))) for a, b in zip(cuts, cuts[1:])]
    return turn, cuts, [c / np.linalg.norm(c, axis=1, keepdims=True) for c in code]


@functools.lru_cache(maxsize=64)
def cap_threshold(dim: int, codes: int, words: int, seed: int, cosine: float, recall: float, pairs: int = 400) -> float:
    """The highest threshold, in standard deviations, at which so large a share of random pairs at the cosine has a filter in common."""
    rng = np.random.default_rng([seed, dim, words])
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    best = np.full(pairs, -np.inf)
    for c in range(codes):
        turn, cuts, code = product_code(dim, words, seed + c)
        parts = [[(x @ turn)[:, cuts[i] : cuts[i + 1]] @ code[i].T for i in range(BLOCKS)] for x in (a, b)]
        step = max(1, (1 << 20) // words**2)
        for k in range(0, pairs, step):
            both = [left[k : k + step, :, None] + right[k : k + step, None, :] for left, right in parts]
            best[k : k + step] = np.maximum(best[k : k + step], np.minimum(*both).max(axis=(1, 2)))
    return float(np.quantile(best, 1 - recall) / np.sqrt(BLOCKS / dim))


def decode(units: np.ndarray, codes: int, words: int, threshold: float, seed: int) -> list[np.ndarray]:
    """List-decode unit vectors: each one's numbers of all filters whose direction it exceeds the threshold with.

    threshold is in standard deviations of a random direction's inner product. A filter is a pair of words of one code, one
    for each block; words that can't reach the threshold with the best partner are pruned before pairs are formed.
    """
    dim = units.shape[1]
    least, found = threshold * np.sqrt(BLOCKS / dim), [[] for _ in units]
    for c in range(codes):
        turn, cuts, code = product_code(dim, words, seed + c)
        turned = units @ turn
        left, right = (turned[:, cuts[i] : cuts[i + 1]] @ code[i].T if cuts[i] < cuts[i + 1] else np.zeros((len(units), words)) for i in range(BLOCKS))
        for a, b, out in zip(left, right, found):
            i, j = np.nonzero(a >= least - b.max())[0], np.nonzero(b >= least - a.max())[0]
            if len(i):
                x, y = np.nonzero(a[i, None] + b[None, j] >= least)
                out.append(c * words * words + i[x] * words + j[y])
    return [np.sort(np.concatenate(f)).astype(np.int32) if f else np.zeros(0, np.int32) for f in found]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one; the largest component goes first, against overflow."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def near_pairs_in(units: np.ndarray, filters: list, mult: np.ndarray, this: int, side: np.ndarray, cosine: float):
    """Within one filter's tile: links counted for each row, and the root of its star.

    Rows of the two sides meet (all rows if there is one side). A pair counts only at the smallest filter that both rows
    have, so that it counts once however many filters they share.
    """
    n, width = len(units), max(map(len, filters))
    table = np.full((n, width), -1, np.int32)
    for i, f in enumerate(filters):
        table[i, : len(f)] = f
    links, count = Links(n), np.zeros(n, np.int64)
    one = (side == side[0]).all()
    first = np.arange(n) if one else np.nonzero(side == 0)[0]
    second = np.arange(n) if one else np.nonzero(side == 1)[0]
    for at in range(0, len(first), 512):
        a = first[at : at + 512]
        x, y = np.nonzero(units[a] @ units[second].T >= cosine)
        x, y = a[x], second[y]
        if one:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 20_000):
            p, q = x[k : k + 20_000], y[k : k + 20_000]
            shared = (table[p][:, :, None] == table[q][:, None, :]).any(axis=2) & (table[p] >= 0)
            mine = table[p][np.arange(len(p)), shared.argmax(axis=1)] == this
            p, q = p[mine], q[mine]
            np.add.at(count, p, mult[q])
            np.add.at(count, q, mult[p])
            links.add(p, q)
    return count, links.settle()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, codes: int = 8, recall: float = 0.99, seed: int = 42, tile_rows: int = 1024) -> DataFrame:
    """(id_col, n_links, component_id, kept): a row for each input row.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept marks that id.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Equal vectors are merged
    first and link with each other. Vectors of different length never link. A pair of exactly the given cosine is found with a
    probability of `recall`, to which the caps are fitted for each number of dimensions by simulated pairs, closer pairs with a higher one, all of them
    below EXACT_BELOW dimensions; all found pairs are verified in double precision. Filters with more than tile_rows vectors
    are compared tile by tile. A null id gets a null component. Other columns aren't read.
    """
    kind = dict(vectors.select(vectors[vector_col].alias("v")).dtypes)["v"]
    kind = "array<float>" if kind == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast(kind).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = keep(rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))), "vectors")
    reps = keep(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")).where("rep is not null"), "reps")

    words, distinct = WORDS, reps.count()
    while WORDS_FOR * (words // WORDS) ** 2 < distinct:
        words *= 2

    def capped(batches):
        for batch in batches:
            vs = batch.column("v")
            size = np.diff(vs.offsets.to_numpy())
            for dim in np.unique(size):
                at = np.nonzero(size == dim)[0]
                flat = vs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                found = decode(unit_rows(flat), codes, words, cap_threshold(int(dim), codes, words, seed, cosine, recall), seed) if dim >= EXACT_BELOW else [np.zeros(1, np.int32)] * len(at)
                part = batch.take(pa.array(at))
                yield pa.record_batch(
                    [part.column("rep"), part.column("mult"), part.column("v"), pa.array(np.full(len(at), dim, np.int32)), pa.array(found, pa.list_(pa.int32()))],
                    names=["rep", "mult", "v", "d", "filters"],
                )

    caps = keep(reps.select("rep", "mult", "v").mapInArrow(capped, f"rep long, mult long, v {kind}, d int, filters array<int>"), "caps")
    sizes = caps.select("d", F.explode("filters").alias("f")).groupBy("d", "f").agg(F.ceil(F.count(F.lit(1)) / F.when(F.col("d") < EXACT_BELOW, 4 * tile_rows).otherwise(tile_rows)).cast("int").alias("g"))
    sizes = keep(sizes.where("g > 1"), "hot_filters")
    tiles = (
        caps.select("*", F.explode("filters").alias("f")).join(sizes, ["d", "f"], "left")
        .withColumn("g", F.coalesce("g", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
        .select("d", "f", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") > F.col("o")).cast("int").alias("side"), "rep", "mult", "v", "filters")
    )

    def verify(table: pa.Table) -> pa.Table:
        rep, mult, side = (table[c].to_numpy() for c in ("rep", "mult", "side"))
        apart = table["x"][0].as_py() != table["y"][0].as_py()
        hit = np.zeros(0, np.int64)
        if len(rep) > 1 and not (apart and (side == side[0]).all()):
            units = unit_rows(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks]).reshape(len(rep), -1))
            filters = [np.asarray(v.values) for v in table["filters"]]
            count, root = near_pairs_in(units, filters, mult, table["f"][0].as_py(), side, cosine)
            hit = np.nonzero(count)[0]
        if not len(hit):
            return pa.table({c: pa.array([], pa.int64()) for c in ("src", "dst", "n")})
        return pa.table({"src": rep[hit], "dst": rep[root[hit]], "n": count[hit]})

    found = keep(tiles.groupBy("d", "f", "x", "y").applyInArrow(verify, "src long, dst long, n long"), "links")
    classes = connected_components(found.select("src", "dst"))
    counts = found.groupBy("src").agg(F.sum("n").alias("n"))
    known = keep(
        reps.join(counts, reps.rep == counts.src, "left").join(classes, reps.rep == classes.node, "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "classes",
    )
    out = rows.join(known, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
