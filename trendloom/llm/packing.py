"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keep

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, int]:
    """The letters that the tokenizer's vocabulary writes bytes with: printable ones stand for themselves, others for 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class Words:
    """Token ids of words under a tokenizer that never joins text across blanks and line feeds.

    A word of lower-case letters only is one piece to it, and goes to its merges at once; any other word is encoded as it is.
    Up to `most` words are remembered, which bounds a worker's memory and changes no result.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.letters = Tokenizer.from_file(path), most, {}, _byte_letters()
        self.model = self.tokenizer.model

    def encode(self, words: list[str]) -> list[bytes]:
        merge, letters, out, other = self.model.tokenize, self.letters, [None] * len(words), []
        for i, w in enumerate(words):
            if w.isalpha() and w.islower() and max(w) < "\u0130":
                tokens = merge(w if w.isascii() else w.encode().decode("latin-1").translate(letters))
                out[i] = np.array([t.id for t in tokens], "<u4").tobytes()
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def look_up(self, words: list[str]) -> list[bytes]:
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            if len(known) + len(fresh) > self.most:
                known = self.known = {}
                fresh = words
            known.update(zip(fresh, self.encode(fresh)))
        return [known[w] for w in words]


#: Letters after which a mark is a piece of its own. The signs U+00D7 and U+00F7, and U+0130, which lower-casing takes apart, are not.
LETTERS = r"a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}"


def apart(texts: pa.Array) -> pa.Array:
    """Texts of the same tokens with fewer distinct words: ASCII letters lower-cased, blanks for line feeds and before marks.

    The tokenizer lower-cases anyway, and marks that follow a letter and end a word are a piece of their own. Texts that may
    hold a special token keep their case, which it looks at.
    """
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    return pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), rf"([{LETTERS}])([.,;:!?]+ )", r"\1 \2")


def token_ids(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, and the texts' offsets there."""
    lists = pc.split_pattern(apart(texts), " ")
    coded = lists.flatten().dictionary_encode()
    found = words.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    flat = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(size) - size
    at = coded.indices.to_numpy()
    n = size[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids, np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, remembered: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end mark, cut where they exceed the capacity."""

    def run(batches):
        words = Words(tokenizer, remembered)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id").to_pylist()
            for a, b in by_bytes(pc.binary_length(texts).to_pylist(), 2 << 20):
                tokens, cuts = token_ids(texts.slice(a, b - a), words)
                out = []
                for k in range(b - a):
                    own = np.append(tokens[cuts[k] : cuts[k + 1]], np.uint32(end_id)).astype("<u4")
                    raw = own.tobytes()
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = raw[4 * start : 4 * (start + capacity)]
                        out.append((ids[a + k], piece, start, len(part) // 4, zlib.crc32(part)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE)


# --- the genetic algorithm: a solution is a list of bins, a bin a tuple of lengths ------------------------------------


def best_fit(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put each length into the fullest bin that still has room, or into a new one."""
    room = {}
    for i, b in enumerate(bins):
        room.setdefault(capacity - sum(b), []).append(i)
    sizes = sorted(k for k in room if k > 0)
    for n in lengths:
        at = bisect_left(sizes, n)
        if at == len(sizes):
            bins.append([n])
            left, i = capacity - n, len(bins) - 1
        else:
            left = sizes[at]
            i = room[left].pop()
            if not room[left]:
                del room[left], sizes[at]
            bins[i].append(n)
            left -= n
        if left > 0:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append(i)
    return bins


def cost(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Bins, then a term that is lower the more of them are filled well."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: list[list[int]], two: list[list[int]], capacity: int, rng: random.Random, share: float) -> list[list[int]]:
    """Inject well-filled bins of one parent into the other, drop the bins that hold their lengths, best-fit the displaced."""
    order = sorted(one, key=lambda b: -sum(b))
    full = order[: max(1, int(len(order) * share))]
    inject = rng.sample(full, max(1, len(full) // 2))
    owed: dict[int, int] = {}
    for b in inject:
        for n in b:
            owed[n] = owed.get(n, 0) + 1
    kept, displaced = [list(b) for b in inject], []
    for b in sorted(two, key=sum):  # the emptiest bins give up duplicates first
        if any(owed.get(n, 0) for n in b):
            for n in b:
                if owed.get(n, 0):
                    owed[n] -= 1
                else:
                    displaced.append(n)
        else:
            kept.append(list(b))
    return best_fit(sorted(displaced, reverse=True), kept, capacity)


def mutate(bins: list[list[int]], capacity: int, rng: random.Random, share: float) -> list[list[int]]:
    """Break up some of the emptiest bins and a few others."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    broken = set(order[: max(1, int(len(order) * share))]) | set(rng.sample(order, max(1, int(len(order) * share / 2))))
    loose = sorted((n for i in broken for n in bins[i]), reverse=True)
    return best_fit(loose, [list(b) for i, b in enumerate(bins) if i not in broken], capacity)


def first_population(lengths: list[int], capacity: int, size: int, rng: random.Random) -> list[list[list[int]]]:
    """Best-fit decreasing, and best fits of orders that are shaken a little."""
    out = [best_fit(sorted(lengths, reverse=True), [], capacity)]
    while len(out) < size:
        out.append(best_fit(sorted(lengths, key=lambda n: -n * rng.uniform(0.9, 1.0)), [], capacity))
    return out


def evolve(population: list, capacity: int, generations: int, rng: random.Random) -> list:
    """Steady-state generations: a child of two parents, mutated, replaces the worst solution if it is better."""
    least = -(-sum(map(sum, population[0])) // capacity) if population[0] else 0
    for _ in range(generations):
        population.sort(key=lambda s: cost(s, capacity))
        if len(population[0]) <= least or len(population) < 2:
            break
        one, two = population[0], population[rng.randrange(1, len(population))]
        child = mutate(crossover(one, two, capacity, rng, 0.3), capacity, rng, 0.02)
        if cost(child, capacity) < cost(population[-1], capacity):
            population[-1] = child
    population.sort(key=lambda s: cost(s, capacity))
    return population


def _flat(bins: list[list[int]]) -> tuple[list[int], list[int]]:
    return [n for b in bins for n in b], [len(b) for b in bins]


def _unflat(lengths, sizes) -> list[list[int]]:
    out, at = [], 0
    for n in sizes:
        out.append([int(x) for x in lengths[at : at + n]])
        at += n
    return out


STATE = "shard int, island int, bins int, fill double, lengths array<int>, sizes array<int>"


def _row(shard: int, island: int, bins: list, capacity: int):
    n, fill = cost(bins, capacity)
    return (shard, island, n, fill, *_flat(bins))


def _table(rows: list) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(STATE.split(", "), zip(*rows), types)})


def pack(pieces: DataFrame, capacity: int, islands: int = 3, epochs: int = 2, population: int = 3, generations: int = 4, shard_rows: int = 8192, seed: int = 42) -> DataFrame:
    """pieces with sequence_id and offset added.

    Pieces are dealt by a hash of their row, a number written with them, to shards of about shard_rows, whatever their ids are. Each island evolves its own population of packings of a shard's
    lengths in a task of its own; after every epoch the best packing of each island migrates to the next one. Pieces of equal
    length are alike, so a packing is one of lengths; a shard's rows take the places of the best one in order of id.
    """
    count = pieces.count()
    shards = max(1, -(-count // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    counts = dealt.groupBy("shard", "length").agg(F.count(F.lit(1)).cast("int").alias("n"))
    spread = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "n"))).alias("counts"))
    start = spread.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "counts")

    def begin(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rng = random.Random(f"{seed}/{r['shard']}/{r['island']}/0")
                lengths = [c["length"] for c in r["counts"] for _ in range(c["n"])]
                found = evolve(first_population(lengths, capacity, population, rng), capacity, generations, rng)
                yield from _table([_row(r["shard"], r["island"], s, capacity) for s in found]).to_batches()

    def further(epoch):
        def run(table: pa.Table) -> pa.Table:
            shard, island = table["shard"][0].as_py(), table["island"][0].as_py()
            rng = random.Random(f"{seed}/{shard}/{island}/{epoch}")
            found = [_unflat(r["lengths"], r["sizes"]) for r in table.sort_by([("bins", "ascending"), ("fill", "ascending")]).to_pylist()]
            found = evolve(found[:population], capacity, generations, rng)
            return _table([_row(shard, island, s, capacity) for s in found])

        return run

    state = keep(start.repartition(max(1, min(shards * islands, 100_000)), "shard", "island").mapInArrow(begin, STATE), "islands")
    for epoch in range(1, epochs):
        best = state.groupBy("shard", "island").agg(F.min(F.struct("bins", "fill", "lengths", "sizes")).alias("b"))
        moved = best.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "b.bins", "b.fill", "b.lengths", "b.sizes")
        state = keep(state.union(moved).groupBy("shard", "island").applyInArrow(further(epoch), STATE), "islands")
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "fill", "island", "lengths", "sizes")).alias("b")).select("shard", "b.lengths", "b.sizes")

    def place(rows: pa.Table, packing: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = np.asarray(packing["lengths"][0].values, np.int64)
        sizes = np.asarray(packing["sizes"][0].values, np.int64)
        which = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(lengths)
        first = np.cumsum(sizes) - sizes
        offset = ends - lengths - (ends - lengths)[first][which]
        order = np.argsort(lengths, kind="stable")
        shard = rows["shard"][0].as_py()
        rows = rows.append_column("sequence_id", pa.array((shard << 32) + which[order], pa.int64()))
        return rows.append_column("offset", pa.array(offset[order], pa.int64())).drop_columns(["shard"])

    schema = f"{PIECE}, sequence_id long, offset long"
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "shard").groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of every document.

    Null and empty texts are one piece that holds the end mark. Documents longer than the capacity are cut into full pieces
    and a rest. Repeated rows are packed as often as they come; a null id is packed like any other. An empty table gives no rows. Other columns
    aren't read.
    """
    pieces = pieces_of(docs, tokenizer, id_col, text_col, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    return pack(keep(pieces, "pieces"), capacity, **options)
