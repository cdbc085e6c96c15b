"""Counts and packed ids of whole texts against the tokenizers' own."""

import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from trendloom.llm import packing, queries, unigram  # noqa: E402

from .test_tokens import NASTY, documents, word_ids  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram_library():
    """The library's unigram encoder over the model's pieces; those that aren't text stand as characters of no use."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = lambda i: not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    vocab = [(sp.id_to_piece(i) if plain(i) else chr(0xF0000 + i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    return Tokenizer(models.Unigram(vocab, sp.unk_id(), True))


def test_counts_equal_the_libraries(spark, docs, unigram_library):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = lambda t: (len(unigram_library.encode(unigram.marked(t or "")).ids), len(own.encode(t or "")))
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["n_model_tokens"]) for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: want(t) for i, t in texts.items()}
    rng = random.Random(4)
    alphabets = ["abcdefgh", "the ing on er", "   ", "▁ ", "é漢字かな\U0001f600", "<=>-_#*!?\n\t\r", "<s></s><unk><0x41>"]
    fuzzed = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 50))) for _ in range(20_000)]
    rows = [*enumerate([*NASTY, *fuzzed]), (None, "null id"), (3, "again")]
    counted = sorted(((str(r[0]), r[1], r[2]) for r in unigram.count_tokens(docs(rows), MODEL).collect()))
    assert counted == sorted((str(i), *want(t)) for i, t in rows)
    assert unigram.count_tokens(docs([]), MODEL).count() == 0


def test_every_letter_before_every_mark():
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"), 100_000)
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
    texts = [f"3{c}4{c}{mark}{gap}y x{c}{mark}{gap}" for c in chars for mark in (".", ",", ";", ":", "!", "?", "?!") for gap in (" ", "\n")]
    ids, cuts = packing.token_ids(pa.array(texts), words)
    for k, t in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == word_ids(t)[:-1], t
