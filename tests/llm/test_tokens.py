"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from trendloom.llm import bpe, packing, unigram  # noqa: E402

NASTY = [None, "", " ", "  x  ", "don't I'LL they'RE", "a\r\n\tb c d", "ünï 漢字 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> <|startoftext|>", "x" * 3000, "1234567 ١٢٣ ½", "İß ǅ ﬁ K", "áé o.K.,!? ...a", "\x00\x01\x7f", "word " * 4000, "?!?! :;., a., b.c, É., É"]


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def tiktoken_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, docs, tiktoken_library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = list(enumerate(NASTY)) + [(1000 + r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(None, "null id")]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(rows), path), path).collect()}
    for i, t in rows:
        assert list(got[i]["ids"]) == tiktoken_library.encode_ordinary(t or ""), t
        assert bytes(got[i]["bytes"]) == (t or "").encode()
    assert bpe.encode(docs([]), path).count() == 0


def test_bpe_numbering_begins_anew(docs, tiktoken_library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40))) for i in range(30)]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs(rows).coalesce(1), path, most_words=50).collect()}
    assert got == {i: tiktoken_library.encode_ordinary(t) for i, t in rows}


@pytest.mark.parametrize("longest", [0, 256])
def test_bpe_of_long_pieces_and_new_scripts(docs, tiktoken_library, longest):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(1)
    alphabets = ["abcdefgh", "aab", "the ing on er", "é漢字かな", "\U0001e030\U0001ccf0\u1c89\U00016d40's 1", "<>=-_#*!?", "ACGT", "    \n\t"]
    rows = [(i, "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, "a" * 5000), (1001, " " * 5000 + "x"), (1002, "".join(rng.choice("ACGT") for _ in range(2000))), (1003, "".join(rng.choice("etaoinshrdlu") for _ in range(600)))]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs(rows), path, longest=longest, most_words=500).collect()}
    assert got == {i: tiktoken_library.encode_ordinary(t) for i, t in rows}


def test_bpe_of_a_very_long_piece(docs, tiktoken_library):
    """200,000 letters, digits, marks and blanks without a break: the time grows about as the length."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(letters) for _ in range(200_000))) for i, letters in enumerate(("etaoinshrdlu", "0123456789", "=-_<>", " ", "漢字かな"))]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(rows), path), path).collect()}
    for i, t in rows:
        assert bytes(got[i]["bytes"]).decode() == t
        assert list(got[i]["ids"]) == tiktoken_library._encode_single_piece(t.encode())


def random_ranks(seed):
    """Bytes and tokens over abc whose ranks are in no order and have gaps, up to some 70,000: some tokens are never merged, some make way for one of lower rank."""
    rng = random.Random(seed)
    tokens = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(30)})
    rng.shuffle(tokens)
    return {bytes([b]): b for b in range(256)} | {t: 256 + 2500 * i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("seed", [1, 3])
def test_bpe_of_ranks_out_of_order(docs, tmp_path, seed):
    import tiktoken

    ranks, rng = random_ranks(seed), random.Random(seed)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, "".join(rng.choice("abcabcabcx ") for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(1000 + i, t.decode("latin-1")) for t, i in ranks.items() if len(t) > 1]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(rows), str(path)), str(path)).collect()}
    for i, t in rows:
        assert list(got[i]["ids"]) == library.encode_ordinary(t), t
        assert bytes(got[i]["bytes"]) == t.encode()
    vocabulary = bpe.Vocabulary(ranks)
    assert {bool(vocabulary.in_order[i]) for t, i in ranks.items() if len(t) > 1} == {True, False}


def test_bpe_lists_the_tokens_within_pieces(tiktoken_library):
    """As many steps of a piece's fold as tokens within it, in order of rank; every one of the tokenizer's is in order."""
    rng = random.Random(3)
    for ranks in [random_ranks(seed) for seed in range(30)] + [bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))]:
        vocabulary = bpe.Vocabulary(ranks)
        letters = "abc" if len(ranks) < 1000 else "theing onér"
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))).encode() for _ in range(200)] + [b"", b"a" * 300]
        piece, token = vocabulary.held(pieces)
        want = [sorted({ranks[p[i:j]] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if p[i:j] in ranks}) for p in pieces]
        assert [token[piece == i].tolist() for i in range(len(pieces))] == want
        for p, merges in zip(pieces, want):
            if vocabulary.in_order[merges].all():
                text = p.decode("latin-1")
                for m in merges:
                    text = text.replace(vocabulary.pairs[m], vocabulary.marks[m])
                assert vocabulary.ids(text).tolist() == bpe.merged(p, ranks, vocabulary.longest)
    assert vocabulary.in_order.all() and len(ranks) == 50_256


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=4), st.integers(-9, -1)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.text("abcd", max_size=12), st.booleans())
@settings(max_examples=300, deadline=None)
def test_viterbi_is_optimal(pieces, word, byte_fallback):
    counter = unigram.Counter([(p, float(s)) for p, s in pieces], byte_fallback)
    scores = dict(pieces)
    # Every way to a place with its score, its count and whether it ends in an unknown character; ties go to the longest last piece.
    best = [(0.0, 0, False)]
    for i in range(1, len(word) + 1):
        found = [(best[j][0] + scores[word[j:i]], -j, best[j][1] + 1, False) for j in range(i) if word[j:i] in scores]
        if word[i - 1] not in scores:
            found.append((best[i - 1][0] + counter.unknown, 1 - i, best[i - 1][1] + (1 if byte_fallback else not best[i - 1][2]), True))
        top = max(found)
        best.append((top[0], top[2], top[3]))
    assert counter.count(word) == best[-1][1]


def word_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "t"):
        word_ids.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return word_ids.t.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, docs, capacity):
    rows = list(enumerate(NASTY)) + [(1000 + r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(5, "again"), (None, "null id")]
    got = packing.pack_documents(docs(rows), public_tokenizers.path("word_bpe_49k.json"), capacity=capacity, shard_rows=512).collect()
    have, want, bins = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), [], defaultdict(list)
    for i, t in rows:
        ids = word_ids(t or "")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((str(i), piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert have == sorted(want)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= capacity
    least = -(-sum(r["length"] for r in got) // capacity)
    assert len(bins) <= least * 1.03 + 2
    assert packing.pack_documents(docs([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(0, 1000))
@settings(max_examples=80, deadline=None)
def test_genetic_steps_keep_every_length(lengths, seed):
    rng = random.Random(seed)
    population = packing.first_population(lengths, 50, 3, rng)
    child = packing.mutate(packing.crossover(population[0], population[1], 50, rng, 0.3), 50, rng, 0.1)
    for bins in [*population, child, *packing.evolve(population, 50, 3, rng)]:
        assert sorted(n for b in bins for n in b) == sorted(lengths) and all(sum(b) <= 50 for b in bins)
    assert len(packing.evolve(population, 50, 3, rng)[0]) <= len(packing.best_fit(sorted(lengths, reverse=True), [], 50))
