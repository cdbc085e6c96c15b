"""Rows that share an id, or have none, don't end up in one group."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendloom.llm import preference


@pytest.mark.parametrize("key", [7, None])
def test_rows_of_one_id_are_dealt_to_many_shards(docs, key):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from trendloom.llm import packing

    rows = [(key, f"word {i % 50}") for i in range(2000)]
    got = packing.pack_documents(docs(rows), public_tokenizers.path("word_bpe_49k.json"), shard_rows=100).collect()
    shards = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 2000 and len(shards) == 20 and max(shards.values()) < 200


def test_turns_without_a_conversation_stay_apart(spark):
    rows = [(None, k, "user", f"t{k}") for k in range(5)] + [(2, 0, "user", "a"), (3, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = preference.gather_turns(turns, *preference.even_and_odd(F.col("conv_id")))
    got = [(r["pair_id"], len(r["chosen"]), len(r["rejected"])) for r in pairs.collect()]
    assert pairs.columns == ["pair_id", "chosen", "rejected"]
    assert sorted(got, key=str) == sorted([(1, 1, 1), *[(None, 0, 0)] * 5], key=str)
