"""The near-duplicate stage against all pairs' exact similarity of five-word shingles."""

import random

import pytest
from .brute import components

import corpus_pipeline
from trendloom.llm import neardup

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=lambda x: (x[0], x[1] or ""))


@pytest.mark.parametrize("length", [25, 400])
def test_planted_pairs_between_08_and_09(spark, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], 0
    while n < 40:
        base = [word() for _ in range(length)]
        copy = list(base)
        for _ in range(100):
            copy[rng.randrange(length)] = word()
            a, b = shingles(" ".join(base)), shingles(" ".join(copy))
            if len(a & b) < 0.9 * len(a | b):
                break
        if similar(a, b):
            rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
            n += 1
    assert [i for i, _ in stage(spark, rows)] == list(range(0, 80, 2))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 90))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "new"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n")]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and (similar(sets[a], sets[b]) if sets[a] or sets[b] else True)]
    assert [i for i, _ in stage(spark, rows)] == sorted(set(components(sets, links).values()))


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[3])]
    assert stage(spark, rows) == [(1, texts[0]), (2, texts[1]), (2, texts[2]), (3, texts[3])]


def test_tiles_link_what_one_tile_links(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, "k", " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(40)]
    docs = spark.createDataFrame([(i, str(i), t) for i, _, t in rows], "doc_id long, key string, text string")
    known = neardup.prints(docs, 5)
    for most in (7, 2048):
        assert len({x for r in neardup.set_links(docs, known, 5, 0.8, most).collect() for x in r}) == 40
