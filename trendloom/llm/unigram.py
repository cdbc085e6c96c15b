"""Token counts by Viterbi over the pieces that an Aho-Corasick automaton enumerates, and by a model's own merges."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")


class Counter:
    """Piece counts of texts under a unigram vocabulary [(piece, score)] of ordinary pieces.

    Every place of a text carries the best score of a way there and that way's piece count; nothing is walked back. Ties keep
    the earliest start, that is the longest piece, as the tokenizer's left-to-right search does. A character that no piece of
    its own covers may be unknown; it counts as its bytes with byte_fallback, else a run of such characters is one token.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.match = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        #: No piece goes on into a space mark, so that words can be counted each by itself.
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", piece) for piece, _ in pieces)

    def count(self, text: str) -> int:
        best, count, lost = [0.0], [0], [False]
        top, n, one = None, 0, False

        def close():
            nonlocal top, n, one
            missing = False
            if not one and (top is None or best[-1] + self.unknown > top):
                top, missing = best[-1] + self.unknown, True
                n = count[-1] + (len(text[len(best) - 1].encode()) if self.byte_fallback else not lost[-1])
            best.append(top)
            count.append(n)
            lost.append(missing)
            top, n, one = None, 0, False

        for last, (size, score) in self.match.iter(text) if len(self.match) else ():
            while len(best) <= last:
                close()
            at = last + 1 - size
            found = best[at] + score
            if top is None or found > top:
                top, n = found, count[at] + 1
            one = one or size == 1
        while len(best) <= len(text):
            close()
        return count[-1]


@functools.lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@functools.lru_cache(maxsize=2)
def load(model: str) -> Counter:
    """The ordinary pieces of a sentencepiece model file, their scores as log-probabilities; bytes stand in for unknown characters if all are there."""
    sp = processor(model)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Counter([(sp.id_to_piece(i), sp.get_score(i)) for i in plain], sum(map(sp.is_byte, ids)) == 256)


def marked(text: str) -> str:
    """The text as the tokenizer sees it: space marks for blanks, and one before it."""
    return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 300_000) -> DataFrame:
    """(id_col, n_tokens, n_model_tokens) of every whole text; null and empty texts have none.

    n_tokens is the piece count of the best way through the text, the model's pieces and scores read as a unigram vocabulary.
    n_model_tokens is the count of the model's own encoding, which is another one where it isn't a unigram model. Texts are cut
    before space marks that follow another character, where neither has a piece across. Rows stay as often as they come;
    other columns aren't read. Counts of up to `cache` short words are remembered in a worker, which bounds its memory and
    changes no result.
    """

    def run(batches):
        counter, own, known = load(model), processor(model), {}
        for batch in batches:
            out = []
            for text in batch.column("text"):
                whole = marked(text.as_py() or "")
                n = m = 0
                for word in _WORD.findall(whole) if counter.cuts else [whole] if whole else []:
                    k = known.get(word)
                    if k is None:
                        k = counter.count(word), len(own.encode(word[1:].replace(SPACE_MARK, " "))) if len(word) > 1 else 1
                        if len(word) < 64:
                            if len(known) >= cache:
                                known.clear()
                            known[word] = k
                    n += k[0]
                    m += k[1]
                out.append((n, m))
            n, m = zip(*out) if out else ((), ())
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["id", "n", "m"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, m long").toDF(id_col, "n_tokens", "n_model_tokens")
