"""The pipeline's stages on the smallest tables, each against what its operator says about the stage's own input."""

import corpus_pipeline
from trendloom.llm import quality, secrets
from trendloom.llm.common import keep

from .brute import components
from .test_neardup import shingles, similar

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())

    kept = keep(corpus_pipeline.quality_rules(spark, docs, DATA), "t")
    assert kept.columns == docs.columns and ids(kept) == ids(quality.judge_quality(docs, labels).where("kept"))
    good = [r[0] for r in labels.where("quality = 1 and toxic = 0").collect()]
    assert sum(i in set(ids(kept)) for i in good) >= 0.9 * len(good)

    one = keep(corpus_pipeline.near_dedup(spark, kept, DATA), "t")
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    groups = components(sets, [(a, b) for a in sets for b in sets if a < b and (similar(sets[a], sets[b]) if sets[a] or sets[b] else True)])
    assert one.columns == docs.columns and ids(one) == sorted(set(groups.values()))

    masked = keep(corpus_pipeline.mask_secrets(spark, one, DATA), "t")
    assert masked.columns == docs.columns and ids(masked) == ids(one)
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(one, secrets.train(one, labels)).collect()}
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (one, masked))
    for i, r in after.items():
        assert (r["text"] == before[i]["text"]) == (not spans[i])
        if spans[i]:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])

    packed = keep(corpus_pipeline.pack_sequences(spark, masked, DATA), "t")
    assert set(r[0] for r in packed.select("doc_id").distinct().collect()) == set(after)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7, 0), (1, "a b c d", "en", "s", 7, 0), (None, "a b c d", "en", "s", 7, 0), (2, None, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    got = sorted((r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str)
    assert got == [1, 2, None]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_clashing_columns_and_missing_ones(spark):
    text = "a b c d e f g h secret=abcdefghijklmnop"
    rows = [(1, text, k, k, k, [k], "n", {"m": k}.get("m")) for k in (1, 2)] + [(5, text, 3, 3, 3, [3], "n", 3), (5, "another text with enough words to be its own", 4, 4, 4, [4], "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_id int, dropped_key int, key int, spans array<int>, row string, text_key int")
    once = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert once.columns == docs.columns
    got = sorted((r["doc_id"], r["spans"][0]) for r in once.collect())
    assert [i for i, _ in got] == [1, 5] and got[0][1] in (1, 2) and got[1][1] == 4
    masked = corpus_pipeline.mask_secrets(spark, docs, DATA)
    assert masked.columns == docs.columns
    assert sorted((r["spans"][0], "[SECRET]" in r["text"]) for r in masked.collect()) == [(1, True), (2, True), (3, True), (4, False)]
    judged = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert judged.columns == docs.columns


def test_maps_in_repeated_rows(spark):
    docs = spark.sql("select 1L doc_id, 'a b c d e f' text, map('k', id % 2) m, array(map(1, 'x')) n from range(4) union all select 2L, null, null, null")
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]
