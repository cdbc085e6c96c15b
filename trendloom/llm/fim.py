"""Fill-in-middle: token boundaries as packed bits with a directory of block counts; ranks give n, selects give the byte cuts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_column

#: Bytes of a block of the directory, each of eight boundary bits.
BLOCK = 64
#: Bytes of text whose bits are held at once, but for a text that is longer by itself.
SLICE = 8 << 20


class Bits:
    """A bit vector: rank(i) counts the ones before bit i, select(k) finds the place of the k-th one (from 0).

    The bits are packed into bytes; a directory holds the ones before each block, so that either question reads one block.
    """

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.concatenate([packed, np.zeros(-len(packed) % BLOCK + BLOCK, np.uint8)]).reshape(-1, BLOCK)
        counts = np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 4096):
            block, bit = np.divmod(at[i : i + 4096], 8 * BLOCK)
            ones = np.unpackbits(self.blocks[block], axis=1, bitorder="little")
            out[i : i + 4096] = self.before[block] + (ones * (np.arange(8 * BLOCK) < bit[:, None])).sum(axis=1, dtype=np.int64)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th one is; every k has to be below the number of ones."""
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 4096):
            part = k[i : i + 4096]
            block = np.searchsorted(self.before, part, side="right") - 1
            ones = np.cumsum(np.unpackbits(self.blocks[block], axis=1, bitorder="little"), axis=1, dtype=np.int64)
            out[i : i + 4096] = 8 * BLOCK * block + (ones <= (part - self.before[block])[:, None]).sum(axis=1)
        return out


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens `[A-Za-z]+|[^A-Za-z]` begin in UTF-8 bytes; a text begins at each of starts."""
    letter = ((data | 32) - np.uint8(97)) < 26
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[starts[starts < len(data)]] = True
    return begins


def draws(seed: int, number: str) -> list[int]:
    """Four 32-bit numbers of a document: the first groups of the sha256 of seed, colon and its number."""
    found = hashlib.sha256(f"{seed}:{number}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(texts: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, by its first two hashes: n, the bytes before the two cuts, and the code points of prefix and middle."""
    ends = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    tokens, chars = Bits(boundaries(data, ends[:-1])), Bits((data & 0xC0) != 0x80)
    first = tokens.rank(ends)
    n = np.diff(first)
    at = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
    places = np.repeat(ends[1:, None], 2, axis=1)
    inside = at < n[:, None]
    places[inside] = tokens.select((first[:-1, None] + at)[inside])
    points = np.diff(chars.rank(np.column_stack([ends[:-1], places]).ravel()).reshape(-1, 3), axis=1)
    return n, places - ends[:-1, None], points[:, 0], points[:, 1]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row; marks open prefix, suffix and middle.

    n counts the text's tokens `[A-Za-z]+|[^A-Za-z]`. Two of a document's four hashes cut it after some of them (both cuts
    may fall together or at an end), the third decides whether it stays plain, the fourth whether the suffix goes first (spm)
    or the prefix (psm). Empty texts and texts that hold a mark stay plain; their counts of characters are null. A null text
    is empty. Hashes are of the seed and the id, so equal ids are cut alike and rows stay as often as they come; a null id is
    hashed as no digits. Other columns aren't read. Text is never decoded: cuts fall between whole characters.
    """
    opened = [m.encode() for m in marks]
    if len({*marks}) < 3 or any(a[-i:] == b[:i] for a in opened for b in opened for i in range(1, min(len(a), len(b)))) or any(a != b and a in b for a in opened for b in opened) or b"" in opened:
        raise ValueError(f"marks that can't be told apart: {marks}")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in by_bytes(pc.binary_length(texts).to_pylist(), SLICE):
                part = texts[a:b].to_pylist()
                ids = batch.column("id")[a:b]
                hashes = np.array([draws(seed, "" if i is None else str(i)) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
                n, places, before, middle = cut(part, hashes)
                plain = np.array([not t or any(m in t for m in opened) for t in part]) | (hashes[:, 2] % 100 >= fim_percent)
                spm = hashes[:, 3] % 100 < spm_percent
                out = []
                for t, (x, y), whole, swap in zip(part, places.tolist(), plain.tolist(), spm.tolist()):
                    head, tail = opened[0] + t[:x], opened[1] + t[y:]
                    out.append(t if whole else (tail + head if swap else head + tail) + opened[2] + t[x:y])
                yield pa.record_batch(
                    [ids, pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()), pa.array(before, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of. A text with marks is plain, so an output of another form holds each mark once."""
    pattern = "|".join(f"\\Q{m}\\E" for m in marks)
    parts = F.split(output, pattern, -1)
    part = lambda i: F.get(parts, F.lit(i))
    whole = F.when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).otherwise(whole)
