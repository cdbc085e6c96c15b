"""Byte-level BPE: a Spark higher-order function folds the ranked merges of distinct words.

Around the fold, Python only numbers the distinct pieces of a task's documents, lists the tokens whose bytes a piece holds
(its merges, by rank) and puts the folded pieces back in their places; nothing is shuffled. Pieces of thousands of bytes,
which no prose has, are merged there by a heap, as a fold goes over the whole piece at every step.
"""

from __future__ import annotations

import base64
import heapq
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_column

#: Bytes of pieces whose merges are listed at once.
PART = 1 << 16
#: Letters and numbers of the tokenizer's Unicode tables (16.0) that a JVM may not know yet (17 has 13.0).
NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA "
    "10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def _class(ranges: str) -> str:
    """A part of a character class; older characters, most of all texts, fail its first half at once."""
    inside = "".join("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in ranges.split())
    return rf"[[\x{{870}}-\x{{10FFFF}}]&&[{inside}]]"


LETTER, NUMBER = rf"\p{{L}}{_class(NEW_LETTERS)}", rf"\p{{N}}{_class(NEW_NUMBERS)}"
#: The split pattern's parts, in order. \s is Unicode white space, as in the tokenizer.
PATTERN = rf"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+)"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(raw: bytes, ranks: dict[bytes, int], longest: int, below: float = math.inf) -> list[int]:
    """Token ids of one piece by the tokenizer's rule: linked tokens and a heap of neighbours by rank, then place. No token is longer than longest; ranks from `below` on don't merge."""
    if ranks.get(raw, below) < below:
        return [ranks[raw]]
    n = len(raw)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token at a place; 0 for a place that has none any more
    waiting = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if ranks.get(raw[i : i + 2], below) < below]
    heapq.heapify(waiting)

    def offer(start: int, stop: int) -> None:
        rank = ranks.get(raw[start:stop]) if stop - start <= longest else None
        if rank is not None and rank < below:
            heapq.heappush(waiting, (rank, start, stop))

    while waiting:
        _, i, stop = heapq.heappop(waiting)
        j = after[i]
        if not j or j == n or after[j] != stop:
            continue  # one of the two has merged with another meanwhile
        after[i], after[j] = stop, 0
        if stop < n:
            before[stop] = i
            offer(i, after[stop])
        if before[i] >= 0:
            offer(before[i], stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[raw[i : after[i]]])
        i = after[i]
    return ids


def mark(token: int) -> str:
    """A token of several bytes as one character, so that Spark's string functions merge; a byte's token is the character of its value."""
    return chr(token + 256 if token + 256 < 0xD800 else token + 256 + 0x800)


class Vocabulary:
    """A rank file: tokens as characters, the pair that each is merged of, and which tokens a piece's bytes hold.

    A token is in order if the merges of lower rank alone make just two tokens of its bytes. Where every token that a piece
    holds is in order, no merge can make way for one of lower rank, and a token comes of that one pair only: between any two
    places that stay token bounds, a piece merges as these bytes alone would. So to merge the lowest-ranked neighbours until
    none has a rank is to go through the held tokens by rank and to replace each one's pair from left to right.
    """

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks, self.longest, top = ranks, max(map(len, ranks)), max(ranks.values())
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        shown = {rank: chr(token[0]) if len(token) == 1 else mark(rank) for token, rank in ranks.items()}
        self.pairs, self.in_order = [None] * (top + 1), np.ones(top + 1, bool)
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merged(token, ranks, self.longest, rank)
                self.in_order[rank] = len(parts) == 2
                self.pairs[rank] = "".join(shown[i] for i in parts)
        self.marks = [shown.get(i) for i in range(top + 1)]
        self.levels = self._levels()

    def __getstate__(self):
        """Without the fold's literals, which Python workers don't need."""
        return {k: v for k, v in vars(self).items() if k not in ("pairs", "marks")}

    def _levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Beginnings of tokens by length: sorted (place of the beginning one byte shorter) * 256 + last byte, and the token that each is, or -1."""
        levels, at, rest = [], {b"": 0}, list(self.ranks)
        for k in range(1, self.longest + 1):
            rest = [t for t in rest if len(t) >= k]
            found = sorted((at[t[:-1]] * 256 + t[-1], t) for t in {t[:k] for t in rest})
            at = {t: i for i, (_, t) in enumerate(found)}
            levels.append((np.array([key for key, _ in found]), np.array([self.ranks.get(t, -1) for _, t in found])))
        return levels

    def held(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(piece, token) for the tokens of two bytes and more within each piece, by piece and rank, each once."""
        text, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece, stop = np.repeat(np.arange(len(pieces)), sizes), np.repeat(np.cumsum(sizes), sizes)
        place, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
        for k, (keys, tokens) in enumerate(self.levels):
            inside = place + k < stop[place]
            place, node = place[inside], node[inside]
            if not len(place):
                break
            key = node * 256 + text[place + k]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            begun = keys[node] == key
            place, node = place[begun], node[begun]
            if k:
                whole = tokens[node] >= 0
                found.append(piece[place[whole]] << 32 | tokens[node[whole]])
        all_ = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return all_ >> 32, all_ & 0xFFFFFFFF

    def fold(self, raw: Column, merges: Column) -> Column:
        """One piece's bytes as marks of its tokens: each merge by rank puts a token's mark in place of its pair; null for null merges."""
        pairs, marks = (F.from_json(F.lit(json.dumps(x)), "array<string>") for x in (self.pairs, self.marks))
        return F.aggregate(merges, F.decode(raw, "ISO-8859-1"), lambda text, m: F.replace(text, F.get(pairs, m), F.get(marks, m)))

    def ids(self, folded: str) -> np.ndarray:
        """Token ids of marks."""
        codes = np.frombuffer(folded.encode("utf-32-le"), np.uint32).astype(np.int32)
        return np.where(codes < 256, self.bytes[np.minimum(codes, 255)], codes - np.where(codes < 0xD800, 256, 256 + 0x800)).astype(np.int32)


PIECES = "gen int, doc boolean, word string, merges array<int>, id long, seq array<int>"


def _rows(gen: int, doc: bool, n: int, word=None, merges=None, id=None, seq=None) -> pa.RecordBatch:
    """n rows of PIECES. Lists and words that a row doesn't have are empty: with each row, Spark's Arrow writer goes over the nulls at a batch's end again."""
    none = pa.ListArray.from_arrays(np.zeros(n + 1, np.int32), np.zeros(0, np.int32))
    given = {"word": word, "merges": merges, "id": id, "seq": seq}
    empty = {"word": pa.array([""] * n, pa.string()), "merges": none, "id": pa.nulls(n, pa.int64()), "seq": none}
    return pa.record_batch({"gen": np.full(n, gen, np.int32), "doc": np.full(n, doc)} | {k: empty[k] if x is None else x for k, x in given.items()})


def _merges(vocabulary: Vocabulary, pieces: list[bytes], longest: int) -> pa.Array:
    """The tokens within each piece by rank; null for pieces of over `longest` bytes or with a token that isn't in order."""
    long_ = np.fromiter((len(p) > longest for p in pieces), bool, len(pieces))
    piece, token = vocabulary.held([b"" if x else p for p, x in zip(pieces, long_)])
    long_[piece[~vocabulary.in_order[token]]] = True
    counts = np.bincount(piece, minlength=len(pieces))
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(token, pa.int32()), mask=pa.array(long_))


def _number_pieces(vocabulary: Vocabulary, most_words: int, longest: int, part: int):
    """Batches of (id, pieces) -> rows of new distinct pieces, each before the documents that are rows of piece numbers."""

    def run(batches):
        known, gen = {}, 0
        for batch in batches:
            lists = batch.column("pieces")
            sizes = np.diff(lists.offsets.to_numpy())
            for a, b in by_bytes(sizes.tolist(), part):
                docs = lists.slice(a, b - a)
                coded = docs.flatten().dictionary_encode()
                if len(known) + len(coded.dictionary) > most_words:
                    known, gen = {}, gen + 1
                words, fresh = coded.dictionary.to_pylist(), []
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                        fresh.append(w)
                at = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                for k in range(0, len(fresh), 10_000):
                    raw = [w.encode() for w in fresh[k : k + 10_000]]
                    for i, j in by_bytes([len(w) for w in raw], PART):
                        yield _rows(gen, False, j - i, word=pa.array(fresh[k + i : k + j], pa.string()), merges=_merges(vocabulary, raw[i:j], longest))
                numbers = at[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int32)
                yield _rows(gen, True, b - a, id=batch.column("id").slice(a, b - a), seq=pa.ListArray.from_arrays(offsets, numbers))

    return run


def _place_ids(vocabulary: Vocabulary):
    """Rows of numbered pieces with their marks, and of documents -> (id, ids). Pieces without marks are merged here."""

    def run(batches):
        gen, flat, size, waiting = None, np.zeros(0, np.int32), np.zeros(0, np.int64), []
        for batch in batches:
            gens = batch.column("gen").to_numpy()
            for g in np.unique(gens):
                part = batch.filter(pa.array(gens == g))
                if g != gen:
                    gen, flat, size, waiting = g, np.zeros(0, np.int32), np.zeros(0, np.int64), []
                is_doc = part.column("doc")
                words, docs = part.filter(pc.invert(is_doc)), part.filter(is_doc)
                if len(words):
                    marks, other = words.column("marks").to_pylist(), words.column("word")
                    own = {i: np.array(merged(other[i].as_py().encode(), vocabulary.ranks, vocabulary.longest), np.int32) for i, m in enumerate(marks) if m is None}
                    sizes = np.fromiter((len(own[i]) if m is None else len(m) for i, m in enumerate(marks)), np.int64, len(marks))
                    ids, ends = vocabulary.ids("".join(m or "" for m in marks)), np.cumsum(sizes)
                    if own:
                        all_, folded = np.empty(ends[-1], np.int32), np.ones(ends[-1], bool)
                        for i, x in own.items():
                            all_[ends[i] - len(x) : ends[i]], folded[ends[i] - len(x) : ends[i]] = x, False
                        all_[folded] = ids
                        ids = all_
                    waiting.append((ids, sizes))
                if not len(docs):
                    continue
                if waiting:
                    flat = np.concatenate([flat, *(w[0] for w in waiting)])
                    size = np.concatenate([size, *(w[1] for w in waiting)])
                    waiting = []
                first = np.cumsum(size) - size
                seqs = docs.column("seq")
                lengths = np.diff(seqs.offsets.to_numpy())
                for a, b in by_bytes(lengths.tolist(), 1 << 20):
                    seq = seqs.slice(a, b - a).flatten().to_numpy()
                    n = size[seq]
                    ends = np.cumsum(n)
                    total = int(ends[-1]) if len(ends) else 0
                    ids = flat[np.repeat(first[seq] - (ends - n), n) + np.arange(total)]
                    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths[a:b])))]
                    yield pa.record_batch([docs.column("id").slice(a, b - a), pa.ListArray.from_arrays(cuts.astype(np.int32), ids)], names=["id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 500_000, longest: int = 4096) -> DataFrame:
    """(id_col, ids): token ids of every whole text, as the tokenizer that has these ranks would give; no special tokens.

    Null and empty texts have no ids. Distinct pieces of a task's documents are folded once by Spark; after most_words of them
    the numbering begins anew, which bounds a worker's memory. Pieces of over `longest` bytes, and those with a token whose
    merges aren't in order of rank, are merged by a heap, to the same ids, in a time that grows about as their length. Rows
    stay as often as they come; other columns are not read.
    """
    vocabulary = Vocabulary(read_ranks(ranks_path))
    pieces = F.regexp_extract_all(text_column(docs, text_col), F.lit(PATTERN), F.lit(1))
    rows = docs.select(docs[id_col].cast("long").alias("id"), pieces.alias("pieces"))
    numbered = rows.mapInArrow(_number_pieces(vocabulary, most_words, longest, 1 << 18), PIECES)
    marks = vocabulary.fold(F.encode("word", "UTF-8"), F.col("merges"))
    folded = numbered.select("gen", "doc", F.when(F.col("merges").isNull(), F.col("word")).otherwise("").alias("word"), marks.alias("marks"), "id", "seq")
    return folded.mapInArrow(_place_ids(vocabulary), "id long, ids array<int>").toDF(id_col, "ids")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with `bytes` added: the tokens' bytes joined; null for null ids or for an id that no token has."""
    ranks = read_ranks(ranks_path)
    names = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        names[rank] = token.hex().upper()
    tokens = F.split(F.lit(",".join(names)), ",")
    return encoded.withColumn("bytes", F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get(tokens, i)), "")))
