"""Cuts and forms against a brute-force version over code points; exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from trendloom.llm import fim

TEXTS = [None, "", "a", "é", "ab cd", "a<P>b", "x <S", "<S", "<M", "M> <P", "\n\t ", "日本語 text́ mixed 🎉 end", "A" * 3000, "é" * 3000, "word " * 5000, "\U0001F600a" * 700, "B", "<<PP>>", "tail\x00nul", "Zz[`{@"]


def brute(number, text, percent=90, spm=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return n, "psm", len(p), len(m), f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


def test_equals_brute_force(docs):
    rng = random.Random(2)
    fuzzed = ["".join(rng.choice("ab Zé語🎉<>PSM\n.") for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = list(enumerate(TEXTS + fuzzed)) + [(None, "null ids are cut too"), (3, "ab cd"), (3, "ab cd"), (-7, "minus seven"), (2**62, "long id")]
    got = fim.fill_in_middle(docs(rows))
    got = got.select("*", fim.restored(got["form"], got["output"]).alias("again")).collect()
    want = sorted(((i, *brute(i, t), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_forms_by_parameters(docs):
    rows = [(i, f"some words number {i}") for i in range(50)]
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    got = fim.fill_in_middle(docs(rows), fim_percent=100, spm_percent=100, marks=marks)
    got = got.select("*", fim.restored(got["form"], got["output"], marks).alias("again")).collect()
    assert all(r["form"] == "spm" and r["again"] == rows[r["doc_id"]][1] and r["output"].startswith(marks[1]) for r in got)
    assert {r["form"] for r in fim.fill_in_middle(docs(rows), fim_percent=0).collect()} == {"plain"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P", "P>", "<M>"), ("", "a", "b"), ("aa", "a", "b")])
def test_marks_that_run_into_each_other_are_refused(docs, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs([]), marks=marks)


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n, share in ((1, 1.0), (511, 0.5), (512, 0.0), (513, 1.0), (20_000, 0.01), (20_000, 0.9)):
        bits = rng.random(n) < share
        v, ones = fim.Bits(bits), np.nonzero(bits)[0]
        at = np.arange(n + 1)
        assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (v.select(np.arange(len(ones))) == ones).all()


def test_slices_change_nothing(docs, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    whole = sorted(map(str, fim.fill_in_middle(docs(rows)).collect()))
    got = []
    for i in range(0, len(rows), 7):
        got += map(str, fim.fill_in_middle(docs(rows[i : i + 7])).collect())
    assert sorted(got) == whole


def test_empty_table(docs):
    assert fim.fill_in_middle(docs([])).collect() == []
