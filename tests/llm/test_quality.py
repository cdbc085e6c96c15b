"""Counts and scores against a brute-force version; accuracy on labels that training didn't see."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from trendloom.llm import quality

TEXTS = [None, "", "   \n ", "one two", "a b c d e f g h i j k", "a b c d e a b c d e", "x x x x x x x x", "# $ one\n\n# $ one\n# $ one \nü|ß*", "a b c d e f g a b c d e f h " * 3, "w w w\x0bw\x1fw " * 7, "lonely " + "long" * 5000, "the cat sat on the mat " * 400]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts(docs):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in quality.base_counts(docs(rows)).collect()}
    for i, t in rows:
        r, want = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def buckets_of(words, n):
    h = lambda w, seed=42: xxhash.xxh64(w.encode(), seed=seed % (1 << 64)).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(h(w)) % n for w in words] + [signed(h(b, h(a))) % n for a, b in zip(words, words[1:])]


def test_ratios_and_scores(docs, spark):
    rows = [(1, "good words are here"), (2, "bad bad words"), (3, "good good words"), (4, None), (None, "words")]
    trusted = spark.createDataFrame([(1,), (3,), (99,)], "id long")
    n = 64
    got = quality.log_ratios(docs(rows), trusted, "doc_id", "text", n)
    raw, good = Counter(), Counter()
    for i, t in rows:
        b = buckets_of((t or "").split(), n)
        raw.update(b)
        if i in (1, 3):
            good.update(b)
    want = [math.log((good[g] + 1) / (sum(good.values()) + n)) - math.log((raw[g] + 1) / (sum(raw.values()) + n)) for g in range(n)]
    assert got == pytest.approx(want)
    scored = {r[0]: r[1] for r in docs(rows).select("doc_id", quality.score(quality.words_of(F.coalesce("text", F.lit(""))), got)).collect()}
    b = buckets_of("good words are here".split(), n)
    assert scored[1] == pytest.approx(sum(want[g] for g in b) / len(b)) and scored[4] == 0.0


def test_labels_out_of_sample(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = l.where("doc_id % 2 = 0"), l.where("doc_id % 2 = 1")
    judged = quality.judge_quality(d, fit).where("not base_failed").join(held, "doc_id")
    n, right = judged.select(F.count(F.lit(1)), F.count_if(F.col("kept") == (F.col("quality") == 1))).first()
    assert n > 50 and right / n > 0.85


def test_nulls_repeats_and_empty(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(None, "a b c d e f g h i j k l"), (1, None), (1, None)]
    got = sorted(((r["doc_id"], r["kept"]) for r in quality.judge_quality(docs(rows), none).collect()), key=str)
    assert got == sorted([(None, True), (1, False), (1, False)], key=str)
    assert quality.judge_quality(docs([]), none).count() == 0


def test_buckets_dont_follow_the_size(docs, spark, monkeypatch):
    """Unrelated text doesn't change how many buckets the n-grams are hashed to."""
    rows = [(i, f"good words number {i % 7} are here and make {i % 3} lines of text for all") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    seen, plain = [], quality.log_ratios
    monkeypatch.setattr(quality, "log_ratios", lambda *a, **b: seen.append(len(r := plain(*a, **b))) or r)
    for d in (rows, rows + [(100 + i, "other " * 20_000) for i in range(200)]):
        assert quality.judge_quality(docs(d), labels).count() == len(d)
    assert seen == [quality.BUCKETS] * 2 == [1 << 16] * 2
