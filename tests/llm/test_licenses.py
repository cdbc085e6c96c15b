"""Phrases against a brute-force version; planted wordings, whole, edited, repeated and cut short."""

import random
import re

import pytest

from trendloom.llm import licenses

MIT, APACHE, GPL = (next(t for label, t in licenses.TEMPLATES if label == name and len(t) > 200) for name in ("mit", "apache", "gpl"))


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    w = words(text)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
    return len(w), places


def planted():
    w = words(MIT)
    rng = random.Random(3)
    changed = [x if i % 12 else "other" for i, x in enumerate(w)]
    grown = [y for i, x in enumerate(w) for y in ([x, "really"] if i % 30 == 7 else [x])]
    less = [x for i, x in enumerate(w) if i % 30 != 11]
    shuffled = rng.sample(w, len(w))
    return [
        f"{filler(40, 1)} {MIT} {filler(40, 2)}", MIT.upper(), f"{filler(5, 3)} {' '.join(changed)}", " ".join(grown), " ".join(less), " ".join(shuffled), " ".join(w[: len(w) // 2]),
        f"{GPL}\n\n{filler(3000, 4)}\n{APACHE}", f"{MIT} {filler(10, 5)} {MIT}", filler(5000, 6), "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "released under a different license",
        "Licensed under the Apache License, Version 2.0. " * 2000, None]


def scanned(docs, texts, **more):
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs(list(enumerate(texts))), **more).collect()}


def filler(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta éclair zwölf 42 omega sigma tau".split()) for _ in range(n))


def test_phrases(docs):
    rng = random.Random(1)
    pieces = ["MIT", "License", "license,", "Apache", "general", "PUBLIC", "Lizenz", "éMIT", "mit-license", "\n", "x2"]
    texts = [None, "", " .;", "MIT License", "mit license" * 3, "the MIT License", "MİT License", "general public license " * 50] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(200)]
    got = scanned(docs, texts)
    for i, t in enumerate(texts):
        n, places = brute(t)
        assert (got[i]["n_words"], sorted((p["at"], p["label"]) for p in got[i]["places"])) == (n, places), t


def test_planted_wordings(docs):
    w, texts = words(MIT), planted()
    got = scanned(docs, texts)
    labels = [sorted({f["label"] for f in got[i]["found"]}) for i in range(len(texts))]
    assert labels == [["mit"]] * 5 + [[], [], ["apache", "gpl"], ["mit"], [], ["mit"], ["cc-by-nc"], [], ["apache"], []]
    first = got[0]["found"]
    assert [(f["start"], f["stop"], f["share"]) for f in first if f["stop"] - f["start"] > 10] == [(40, 40 + len(w), 1.0)]
    assert len([f for f in got[8]["found"] if f["stop"] - f["start"] == len(w)]) == 2
    assert all(0.8 <= f["share"] <= 1 for r in got.values() for f in r["found"])


def test_no_span_at_the_share_is_lost(docs):
    """A template whose words are changed at random places: found exactly where four fifths of them stay."""
    rng, w = random.Random(9), words(APACHE)
    template = [("own", APACHE)]
    texts, kept = [], []
    for _ in range(60):
        out = set(rng.sample(range(len(w)), rng.randrange(len(w) // 3)))
        texts.append(" ".join("zzz" if i in out else x for i, x in enumerate(w)))
        kept.append(1 - len(out) / len(w))
    got = scanned(docs, texts, templates=template)
    assert [bool(got[i]["found"]) for i in range(60)] == [k >= 0.8 for k in kept] and 5 < sum(k >= 0.8 for k in kept) < 55
    assert all(got[i]["found"][0]["share"] == pytest.approx(k) for i, k in enumerate(kept) if k >= 0.8)


def test_repeated_rows_and_null_ids(docs):
    rows = [(1, MIT), (1, MIT), (1, GPL), (None, MIT), (None, MIT), (None, "plain words only here"), (2, None)]
    got = sorted((str(r["doc_id"]), r["n_words"], sorted({(f["label"], f["share"]) for f in r["found"]})) for r in licenses.scan_licenses(docs(rows)).collect())
    n = {t: len(words(t)) for t in (MIT, GPL)}
    assert got == sorted([("1", n[MIT], [("mit", 1.0)]), ("1", n[MIT], [("mit", 1.0)]), ("1", n[GPL], [("gpl", 1.0)]), ("None", n[MIT], [("mit", 1.0)]), ("None", n[MIT], [("mit", 1.0)]), ("None", 4, []), ("2", 0, [])])


def test_empty_tables_and_templates(docs, spark):
    assert licenses.scan_licenses(docs([])).collect() == []
    assert [r["found"] for r in licenses.scan_licenses(docs([(1, MIT)]), templates=[]).collect()] == [[]]
    with pytest.raises(ValueError):
        licenses.template_table(spark, [("short", "two words")], 4, 0.8)


def test_given_documents(spark):
    """Every notice of the test documents is found."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    notices = {"mit": "Released under the MIT License", "apache": "Licensed under the Apache License, Version 2.0", "gpl": "licensed under the GNU General Public License, version 3", "cc-by-nc": "Licensed under CC BY-NC 4.0"}
    got = {r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan_licenses(d).collect()}
    assert got == {i: {k for k, n in notices.items() if n in (t or "")} for i, t in texts.items()} and any(got.values())


def test_sql_says_the_same(spark, docs, monkeypatch):
    """Also for edited, repeated and cut wordings, phrases and words beyond ASCII."""
    import duckdb
    import pyarrow as pa

    from trendloom.llm import queries

    rng = random.Random(12)
    pieces = words(MIT)[:30] + words(APACHE)[:30] + ["MIT License", "apache license", "general public license", "é", "İ"]
    texts = planted() + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(200))) for _ in range(60)]
    for base in (MIT, APACHE, GPL):
        for _ in range(25):
            out = [x for x in words(base) if rng.random() > 0.06]
            texts.append(" ".join(y for x in out for y in ([x] if rng.random() > 0.08 else [rng.choice(["more", x + "s"]), x][: rng.randrange(1, 3)])))
    rows = list(enumerate(texts)) + [(None, MIT), (3, texts[3])]
    monkeypatch.setattr(queries, "table", lambda *_: docs(rows))
    got = queries.op13_license_scan(spark, "")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    want = con.execute(queries.oracle_sql()["op13_license_scan"])
    names = [c[0] for c in want.description]
    tidy = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tidy, got.select(*names).collect()), key=str) == sorted(map(tidy, want.fetchall()), key=str)
