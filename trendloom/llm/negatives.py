"""Hard negatives: exact searches over k-means inverted lists that Cauchy-Schwarz bounds cut short."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Rows that the centroids are fitted to at most, and lists at most: what the driver and every task hold of the index.
MOST_FIT, MOST_LISTS = 20_000, 1024
#: Fixed value: whole vectors of this length and more take no part, as their scores might not fit into 64 bits.
LONGEST = 2**31


def centroids(rows: np.ndarray, lists: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """K-means over the rows of the sample; a list that loses all its rows keeps its place."""
    at = rows[np.random.default_rng([seed, rows.shape[1]]).permutation(len(rows))[:lists]]
    for _ in range(rounds):
        own = nearest(rows, at)
        count = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        at = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], at)
    return at


def nearest(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which centroid is closest; the smallest number of ties."""
    half = (at * at).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ at.T - half, axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


def fit(rows: DataFrame, n: int, most_fit: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, fitted to the most_fit rows of smallest hash at most; sqrt(n) / 4 lists in all, MOST_LISTS at most."""
    sample = rows.select("d", "v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(most_fit).toArrow()
    size, lists = sample["d"].to_numpy(), min(MOST_LISTS, max(8, int(n**0.5 / 4)))
    found = {}
    for d in np.unique(size).tolist():
        part = matrix(sample["v"].combine_chunks().take(pa.array(np.nonzero(size == d)[0]))).astype(np.float64)
        found[d] = centroids(part, max(1, lists * len(part) // len(size)))
    return found


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors; as floating-point numbers where all of them and their partial sums are exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    exact = np.sqrt((x * x).sum(axis=1).max(initial=0) * (y * y).sum(axis=1).max(initial=0)) < 2**52
    return x @ y.T if exact else a @ b.T


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the hits are among the k highest scores of their row, ties by smaller id; in order."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def label_bit(label):
    """A label as one of 64 bits; lists of a centroid know the bits of their labels."""
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({label}), 64) as int))")


def visits(anchors: DataFrame, index: dict[int, np.ndarray], radii: dict[tuple[int, int], tuple[float, int]], same: bool, first: int, last: int, schema: str) -> DataFrame:
    """anchors, each with every list of its visits number first to last - 1 that may still matter, as column c.

    An anchor visits lists in order of the bound a.m + |a| r on the scores of a list of centroid m and radius r; wants holds
    the windows of scores (low, high, least) it looks for. A list matters to a window if its bound reaches low and `least`,
    the kth best found, and a.m - |a| r doesn't exceed high; with `same` also only if it may hold the anchor's label. Vectors of a length that the sample lacks have one list without a bound.
    """
    of = lambda d, m, i, none: np.array([radii.get((d, c), (none, none))[i] for c in range(len(m))])
    known = {d: (m, of(d, m, 0, -1.0), of(d, m, 1, 0).astype(np.int64)) for d, m in index.items()}

    def run(batches):
        for batch in batches:
            size, bit = batch.column("d").to_numpy(), batch.column("bit").to_numpy()
            batch = batch.drop_columns(["bit"])
            at, lists = [], []
            wants = batch.column("wants").to_pylist()
            for d in np.unique(size).tolist():
                rows = np.nonzero(size == d)[0]
                if d not in known:
                    if not first:
                        at += rows.tolist()
                        lists += [0] * len(rows)
                    continue
                m, radius, labels = known[d]
                held = np.nonzero(radius >= 0)[0]
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    a = matrix(batch.column("v").take(pa.array(part))).astype(np.float64)
                    length = np.sqrt((a * a).sum(axis=1))[:, None]
                    middle, wide = a @ m[held].T, length * radius[held]
                    slack = 1e-9 * (length * np.sqrt((m[held] ** 2).sum(axis=1)) + wide) + 1e-6
                    order = np.argsort(-(middle + wide), axis=1, kind="stable")[:, first:last]
                    high, low = (np.take_along_axis(x, order, axis=1) for x in (middle + wide + slack, middle - wide - slack))
                    for k, row in enumerate(part.tolist()):
                        hit = np.zeros(order.shape[1], bool)
                        may = (labels[held[order[k]]] & bit[row]) != 0 if same else True
                        for w in wants[row]:
                            hit |= may & (high[k] >= max(w["low"], w["least"])) & (low[k] <= w["high"])
                        found = held[order[k][hit]].tolist()
                        at += [row] * len(found)
                        lists += found
            for i in range(0, len(at), 4096):
                part = batch.take(pa.array(at[i : i + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists[i : i + 4096], pa.int32())], names=[*part.schema.names, "c"])

    return anchors.withColumn("bit", label_bit("label")).mapInArrow(run, f"{schema}, c int")


def search(anchors: DataFrame, lists: DataFrame, blocks: DataFrame, index: dict, radii: dict, same: bool, k: int, first: int = 4, growth: int = 8, tile_rows: int = 8192) -> DataFrame:
    """(row, w, id, score, rank): for each window w of each anchor its k best rows, of the anchor's label or of the others.

    anchors(row, id, label, d, v, wants). In rounds each anchor visits its next lists, `growth` times as many as before, and
    drops out when no list left can matter. A list is dealt in blocks of a bounded size, which the anchors that ask for it meet
    in tiles of a bounded size; of an anchor and block at most k rows a window leave the task.
    """
    schema = "row long, id long, label int, d int, v array<long>, wants array<struct<low:long,high:long,least:long>>"
    found, last, total = None, 0, max([1, *map(len, index.values())])
    top = Window.partitionBy("row", "w").orderBy(F.col("score").desc(), "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("row", "w", "id", "score")}
        if len(left) and len(right):
            right = right.sort_by("id")
            ids, labels, rows = right["id"].to_numpy(), right["label"].to_numpy(), matrix(right["v"])
            for i in range(0, len(left), 256):
                part = left.slice(i, 256)
                own, tag = part["id"].to_numpy(), part["label"].to_numpy()
                s = scores(matrix(part["v"]), rows)
                fits = labels == tag[:, None]
                fits = fits & (ids != own[:, None]) if same else ~fits
                wants = part["wants"].to_pylist()
                most = max(map(len, wants))
                # A window that an anchor hasn't got holds nothing.
                low, high = (np.array([[f(w) for w in x] + [none] * (most - len(x)) for x in wants], np.int64) for f, none in ((lambda w: max(w["low"], w["least"]), 2**62), (lambda w: w["high"], -(2**62))))
                r, c = np.nonzero(fits & (s >= low.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None]))
                found_, named = s[r, c].astype(np.int64), part["row"].to_numpy()
                for w in range(most):
                    at = np.nonzero((found_ >= low[r, w]) & (found_ <= high[r, w]))[0]
                    at = at[best(r[at], found_[at], ids[c[at]], k)]
                    for name, x in (("row", named[r[at]]), ("w", np.full(len(at), w, np.int32)), ("id", ids[c[at]]), ("score", found_[at])):
                        out[name].append(x)
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.int32 if c == "w" else np.int64) for c, x in out.items()})

    while last < total:
        last, start = min(total, last * growth or first), last
        asked = anchors
        if found is not None:
            least = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
            now = F.transform("wants", lambda x, w: x.withField("least", F.greatest(x["least"], F.try_element_at("reached", w))))
            asked = anchors.join(least, "row", "left").withColumn("wants", now)
        asked = keep(visits(asked.select("row", "id", "label", "d", "v", "wants"), index, radii, same, start, last, schema), "visits")
        tiles = keep(asked.groupBy("d", "c").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles")).join(blocks, ["d", "c"]), "tiles")
        here = asked.join(tiles, ["d", "c"]).withColumn("t", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        there = lists.join(tiles.drop("g"), ["d", "c"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        pairs = here.drop("tiles", "g").groupBy("d", "c", "b", "t").cogroup(there.drop("tiles").groupBy("d", "c", "b", "t"))
        more = pairs.applyInArrow(run, "row long, w int, id long, score long")
        found = (found.drop("rank").unionByName(more) if found is not None else more).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        found = keep(found, "found")
    return found


def hard_negatives(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, most_fit: int = MOST_FIT, block_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, positive and negative.

    Each component x becomes floor(scale * x); a score is the inner product of two such vectors, higher ones first, ties by
    smaller id. An anchor's positives are its best other rows of the same label, the negatives of a positive of score p the
    best rows of other labels whose score is `low` to `high` hundredths of p, both ends included. Anchors are the rows where
    is_anchor, a condition on the id, holds. Results are exact: the index, fitted to most_fit rows at most, only decides
    which lists have to be read.

    Rows with a null id, label or vector, with a null or non-finite component, or whose whole vector has a length of 2^31 or
    more (scores might not fit) take no part. Vectors of different length never meet; empty ones have score zero with each
    other. Rows equal in id, label and vector count once; other rows of one id are rows of their own, but none is a positive of
    its own id. Other columns aren't read.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("int").alias("label"), F.transform(vectors[vector_col].cast("array<double>"), lambda x: x * scale).alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LONGEST)))
    rows = rows.where("id is not null and label is not null and x is not null").where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("id", "label", F.size("x").alias("d"), F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) < float(LONGEST) ** 2)
    rows = keep(rows.distinct(), "vectors")
    n = rows.count()
    index = fit(rows, n, most_fit)

    def assign(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            c, far = np.zeros(len(size), np.int32), np.zeros(len(size))
            for d in np.unique(size).tolist():
                if d in index:
                    at = np.nonzero(size == d)[0]
                    v = matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                    c[at] = nearest(v, index[d])
                    far[at] = np.sqrt(((v - index[d][c[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c), pa.array(far)], names=[*batch.schema.names, "c", "far"])

    lists = keep(rows.mapInArrow(assign, "id long, label int, d int, v array<long>, c int, far double"), "lists")
    sizes = keep(lists.groupBy("d", "c").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.bit_or(label_bit("label")).alias("labels")), "list_sizes")
    known = sizes.where(F.col("d").isin(list(index) or [-1])).select("d", "c", "radius", "labels").collect()  # a row a list of the index
    radii = {(r["d"], r["c"]): (r["radius"], r["labels"]) for r in known}
    blocks = sizes.select("d", "c", F.ceil(F.col("n") / block_rows).cast("int").alias("g"))
    dealt = lists.join(F.broadcast(blocks.where(F.col("d").isin(list(index) or [-1]) & (F.col("g") > 1))), ["d", "c"], "left") if known else lists.withColumn("g", F.lit(1))
    if len(known) < sizes.count():  # lists of lengths that the sample lacks
        dealt = lists.join(blocks, ["d", "c"], "left")
    dealt = keep(dealt.select("d", "c", F.pmod(F.xxhash64("id", "v"), F.coalesce("g", F.lit(1))).cast("int").alias("b"), "id", "label", "v"), "blocks")

    whole = F.struct(F.lit(-(2**63) + 1).cast("long").alias("low"), F.lit(2**63 - 1).cast("long").alias("high"), F.lit(-(2**63) + 1).cast("long").alias("least"))
    anchors = keep(rows.where(is_anchor(F.col("id"))).select(F.monotonically_increasing_id().alias("row"), "id", "label", "d", "v", F.array(whole).alias("wants")), "anchors")
    near = search(anchors, dealt, blocks, index, radii, True, positives)
    # Hundredths of a score of up to 62 bits are compared as decimals.
    share = lambda x, f: (F.expr(f"cast({f}(cast(score as decimal(20,0)) * {x} / 100) as bigint)"))
    window = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share(low, "ceil").alias("low"), share(high, "floor").alias("high"))
    pairs = keep(near.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("pairs")), "positives")
    wanted = F.transform("pairs", lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high"), p["low"].alias("least")))
    asked = keep(anchors.drop("wants").join(pairs.select("row", wanted.alias("wants")), "row"), "anchors")
    hard = search(asked, dealt, blocks, index, radii, False, negatives)
    one = pairs.select("row", F.posexplode("pairs").alias("w", "p"))
    out = hard.join(one, ["row", "w"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
