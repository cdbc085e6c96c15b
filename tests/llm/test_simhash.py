"""Fingerprints and groups against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash
from .brute import components

from trendloom.llm import simhash
from trendloom.llm.components import connected_components


def brute_fingerprint(text, size=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(1, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            texts.append((" " if rng.random() < 0.2 else "\t").join([" ".join(copy[:5]), " ".join(copy[5:])]))
    texts += [None, "", " \n\t", "one", "ONE", "one two three", texts[0], texts[0].upper(), "x " * 5000]
    return [(i * 3 % 401, t) for i, t in enumerate(texts)]


def test_against_brute_force(docs):
    rows = fixture()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == components(fps, links)


def test_parts_of_long_texts(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART", 97)
    assert simhash.fingerprint(text) == whole == np.array([brute_fingerprint(text)], np.uint64).view(np.int64)[0]


def test_null_ids_repeats_and_empty(docs):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, None), (None, "lonely words of no other text at all")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("rows", [2, 16, 256])
def test_tiles_find_every_pair(rows):
    rng = np.random.default_rng(rows)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a[100:200] = a[:100] ^ (np.uint64(1) << rng.integers(0, 60, 100).astype(np.uint64))
    links = simhash.Links(len(a))
    simhash.compare(a[:, None], None, 4, links, rows)
    pairs = [(i, j) for i in range(300) for j in range(i) if int(a[i] ^ a[j]).bit_count() <= 4]
    want = components(range(300), pairs)
    root = links.settle()
    assert {i: int(root[i]) for i in range(300)} == want
    both = simhash.Links(300)
    simhash.compare(a[:100, None], a[100:, None], 4, both, rows)
    cross = components(range(300), [(i, j) for i, j in pairs if j < 100 <= i])
    assert {i: int(both.settle()[i]) for i in range(300)} == cross


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = components({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    assert got == want
