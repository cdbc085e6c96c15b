"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio of trusted against raw text. DataFrame only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, keep, let, text_column

#: The characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
EMPTY = "array<bigint>"
#: Buckets that n-grams are hashed to, at any size of the corpus: a verdict depends on what is counted, not on how much.
BUCKETS = 1 << 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def grams(words: Column, buckets: int) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of `size` words that the text holds twice or more, the first one included."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        """windows: hashes in order. Those equal to a neighbour once sorted give their positions; gaps cap what each adds."""
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            twin = lambda i, x: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(p, lambda x, i: twin(i + 1, x) | twin(i - 1, x)), lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(size))).alias("n"), i.alias("last"))
        return F.aggregate(let(pairs, marked), start, step, lambda acc: acc["n"])

    def windowed(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), n - size)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.when(n >= size, let(hashed, windowed)).otherwise(F.array().cast(EMPTY))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added."""
    text = text_column(docs, text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("words", words_of(text)).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": repeated_words(F.col("words")),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def held_out(id_: Column) -> Column:
    """A third of the ids, by hash: labels that the model isn't fitted to and that the threshold is."""
    return F.pmod(F.xxhash64(id_, F.lit("held out")), F.lit(3)) == 0


def trusted_ids(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """Ids of trusted documents, those of smallest hash if there are more than `most`: the bound that lets them be broadcast."""
    ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id is not null").where(~held_out(F.col("id"))).distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smoothing: float = 1.0) -> list[float]:
    """For each bucket, log of its smoothed share in trusted documents over that in all documents.

    All documents are counted; the driver gets one row a bucket at most.
    """
    words = docs.select(docs[id_col].cast("long").alias("id"), words_of(text_column(docs, text_col)).alias("words"))
    marked = words.join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "id", "left")
    rows = marked.select("trusted", F.explode(grams(F.col("words"), buckets)).alias("g"))
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("g").agg(F.count(F.lit(1)), F.count("trusted")).collect()}
    raw, good = (sum(v[i] for v in found.values()) + smoothing * buckets for i in (0, 1))
    ratio = lambda a, b: math.log((b + smoothing) / good) - math.log((a + smoothing) / raw)
    return [ratio(*found.get(g, (0, 0))) for g in range(buckets)]


def score(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; zero without any."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    found = grams(words, len(ratios))
    total = F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def best_threshold(scored: DataFrame, cells: int = 2000, low: float = -5.0, high: float = 5.0) -> float | None:
    """scored(score, label 0 or 1, weight): the cut with the fewest mistakes by weight; the middle of such cuts.

    None without both classes. The driver gets a row a cell and class at most.
    """
    cell = F.floor((F.least(F.greatest("score", F.lit(low)), F.lit(high)) - low) * cells / (high - low))
    rows = scored.where("label in (0, 1)").groupBy(cell.alias("c"), "label").agg(F.sum("weight")).collect()
    count = {(r[0], r[1]): r[2] for r in rows}
    if len({label for _, label in count}) < 2:
        return None
    wrong, best, least = sum(n for (_, label), n in count.items() if label == 0), [], None
    for c in range(cells + 2):
        if least is None or wrong < least:
            least, best = wrong, []
        if wrong == least:
            best.append(c)
        wrong += count.get((c, 1), 0) - count.get((c, 0), 0)
    run = next((i for i, (a, b) in enumerate(zip(best, best[1:])) if b > a + 1), len(best) - 1)
    return low + (best[0] + best[run]) / 2 * (high - low) / cells


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, most_trusted: int = 20_000, carry: bool = False) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    A document is kept if it passes the base rules and its length-normalised log-likelihood ratio reaches the threshold,
    which is fitted to labelled documents that pass the base rules: all bad ones, and those good ones, a third by hash and each
    weighing as three, that the model hasn't seen. The model has `buckets` n-gram buckets. The trusted side of the model is a sample of most_trusted of the other good ones at most, the raw side
    all documents. Null texts count as empty: no words, base_failed.
    Without trusted documents, or without labels of both kinds, the ratio has no vote. Rows stay as often as they come; a
    null id is judged like any other; other columns aren't read. With carry they stay, all columns of docs in a struct `row`, so
    that nobody has to join texts to verdicts.
    """
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), *more)
    carried = ["row"] if carry else []
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    trusted = keep(trusted_ids(ids, "doc_id", "label", most_trusted), "trusted")
    ratios = log_ratios(rows, trusted, "id", "text", buckets)
    counted = base_counts(rows, "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = keep(counted.select("id", *counts, score(F.col("words"), ratios).alias("score"), *carried), "judged")
    known = ids.groupBy("doc_id").agg(F.min("label").alias("label"))
    unseen = known.where((F.col("label") == 0) | held_out(F.col("doc_id")))
    weighed = unseen.withColumn("weight", F.when(F.col("label") == 0, 1).otherwise(3))
    threshold = best_threshold(judged.where("not base_failed").join(weighed, judged.id == weighed.doc_id).select("score", "label", "weight"))
    passes = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    return judged.select(F.col("id").alias(id_col), *counts, "score", (~F.col("base_failed") & passes).alias("kept"), *carried)
