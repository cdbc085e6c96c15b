"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers. DataFrame only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, let, scan, text_column

#: The patterns of each kind, the group whose length counts, and the least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
#: Candidates of the models: whole runs of these characters, this long at least.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,})"
#: Characters from which on a candidate's mean counts in full; shorter ones, with less evidence, need a higher mean.
FULL = 20
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def _no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, groups: list[int]) -> Column:
    """array<struct(start, g...)> of non-overlapping matches, leftmost first: code-point offset, whole match, then groups.

    Pieces between the matches give the offsets: a split has one piece more than there are matches.
    """
    lit = F.lit(pattern)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    more = [F.regexp_extract_all(text, lit, F.lit(g)) for g in groups]
    parts = F.arrays_zip(whole.alias("w"), F.split(text, pattern, -1).alias("p"), *[m.alias(f"g{i}") for i, m in enumerate(more)])
    kind = "struct<start:bigint,w:string" + "".join(f",g{i}:string" for i in range(len(groups))) + ">"

    def step(at, x):
        start = at + F.length(x["p"])
        hit = F.struct(start.alias("start"), x["w"].alias("w"), *[x[f"g{i}"].alias(f"g{i}") for i in range(len(groups))])
        return F.struct((start + F.coalesce(F.length(x["w"]), F.lit(0))).alias("state"), F.when(x["w"].isNotNull(), hit).alias("out"))

    return F.when(text.rlike(pattern), let(parts, lambda found: scan(found, F.lit(0).cast("bigint"), step, kind))).otherwise(F.array().cast(f"array<{kind}>"))


def base_spans(text: Column, rank: int) -> Column:
    """Spans of one fixed kind, in order; matches whose counted group is too short drop out after matching."""
    kind, pattern, group, least = BASE[rank]
    found = F.filter(matches(text, pattern, [group]), lambda m: F.length(m["g0"]) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["w"])).alias("stop")))


def apart(found: Column, base: Column) -> Column:
    """Those of the matches that overlap no span of base: neither one that starts before them nor one that starts within."""
    event = lambda x, rank, stop, w: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), w.alias("w"))
    mine = F.transform(found, lambda m: event(m, 1, m["start"] + F.length(m["w"]), m["w"]))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, 0, s["stop"], F.lit(None).cast("string"))), mine))
    fixed = lambda x: x["rank"] == 0
    # The furthest stop of the spans so far, and from behind the nearest start of the spans to come.
    before = lambda state, x: F.struct(F.when(fixed(x), F.greatest(state, x["stop"])).otherwise(state).alias("state"), (state <= x["start"]).alias("out"))
    after = lambda state, x: F.struct(F.when(fixed(x), x["start"]).otherwise(state).alias("state"), (state >= x["stop"]).alias("out"))

    def free(ordered):
        ahead = scan(ordered, F.lit(0).cast("bigint"), before, "boolean")
        behind = F.reverse(let(F.reverse(ordered), lambda back: scan(back, F.lit(1 << 62).cast("bigint"), after, "boolean")))
        marked = F.zip_with(F.zip_with(ordered, ahead, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), behind, lambda y, g: F.when(y["f"] & g & ~fixed(y["x"]), F.struct(y["x"]["start"].alias("start"), y["x"]["w"].alias("w"))))
        return F.filter(marked, lambda m: m.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(let(events, free))


def samples_of_random(spark: SparkSession, count: int) -> DataFrame:
    """Labelled random strings: base-64 and hexadecimal forms of digests of 0 ... count - 1."""
    raw = spark.range(count).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    coded = F.base64(F.unhex("h"))
    return raw.select(F.explode(F.array(F.substring(coded, 1, 40), F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 32), F.substring("h", 1, 40))).alias("token"))


def samples_of_identifiers(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Labelled ordinary tokens: those of trusted documents, outside the spans of the fixed patterns."""
    rows = docs.join(F.broadcast(trusted), docs[id_col] == trusted["trusted_id"], "left_semi").select(text_column(docs, text_col).alias("t"))
    for _, pattern, _, _ in BASE:
        rows = rows.select(F.regexp_replace("t", pattern, " ").alias("t"))
    return rows.select(F.explode(F.split("t", r"[^A-Za-z0-9+/_=-]+")).alias("token")).where(F.length("token") >= 4)


def transitions(tokens: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of neighbouring characters; the driver gets one row for each pair of the alphabet at most."""
    chars = tokens.select(F.split("token", "").alias("c"))
    pairs = F.filter(F.zip_with("c", F.slice("c", F.lit(2), F.size("c")), lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
    rows = chars.select(F.explode(pairs).alias("p")).groupBy("p").count().collect()
    return {(r["p"][0], r["p"][1]): r["count"] for r in rows}


def log_ratios(random: dict, ordinary: dict, smoothing: float = 0.5) -> list[float]:
    """log P(next | this) under the random model less that under the ordinary one, row by row of CHARACTERS."""
    out = []
    for a in CHARACTERS:
        sums = [sum(m.get((a, b), 0) for b in CHARACTERS) + smoothing * len(CHARACTERS) for m in (random, ordinary)]
        for b in CHARACTERS:
            x, y = ((m.get((a, b), 0) + smoothing) / s for m, s in zip((random, ordinary), sums))
            out.append(round(math.log(x / y), 6))
    return out


def token_score(token: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a token's transitions. Characters outside CHARACTERS don't occur in candidates."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    spots = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, i):
        add = F.when(acc["last"] >= 0, F.get(table, acc["last"] * len(CHARACTERS) + i)).otherwise(F.lit(0.0))
        return F.struct(i.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(spots, start, step, lambda acc: acc["sum"]) / (F.length(token) - 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_trusted: int = 2_000, random_count: int = 4_096) -> list[float]:
    """The log ratios of a model fitted to labelled samples: most_trusted documents of good quality at most, and
    3 * random_count random strings. An empty labels table leaves the ordinary model uniform."""
    ids = labels.where(F.col("quality") == 1).select(labels["doc_id"].cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    trusted = keep(ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most_trusted), "trusted")
    return log_ratios(transitions(samples_of_random(docs.sparkSession, random_count)), transitions(samples_of_identifiers(docs, trusted, id_col, text_col)))


def find_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, spans_col: str = "spans") -> DataFrame:
    """docs with spans_col added: array of (start, rank, kind, stop) in code points, by start, then kind.

    Fixed kinds (assign, access, hex) come first; kind model adds candidates whose mean log ratio reaches the threshold and
    which overlap no fixed span. Work grows with a text's length and matches, not with their square. Null texts count as empty and have none. Rows and columns stay as they are, but
    a column of that name is replaced.
    """
    text = text_column(docs, text_col)
    fixed = [base_spans(text, rank) for rank in range(len(BASE))]

    def scored(base: Column) -> Column:
        likely = apart(F.filter(matches(text, CANDIDATE, []), lambda m: F.least(F.lit(1.0), F.length(m["w"]) / F.lit(FULL)) * token_score(m["w"], ratios) >= threshold), base)
        spans = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("model").alias("kind"), (m["start"] + F.length(m["w"])).alias("stop")))
        return F.array_sort(F.concat(base, spans))

    return docs.withColumn(spans_col, F.concat(*fixed)).withColumn(spans_col, scored(F.col(spans_col)))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones merged, replaced by the mark. spans: by start."""
    size = 4096

    def cut(blocks, start, stop):
        """Characters of the text from its blocks, as a substring counts from the first one each time."""
        first = F.floor(start / F.lit(size)).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(stop / F.lit(size)).cast("int") - first + 1), "")
        return F.substring(near, (start - first * size + 1).cast("int"), (stop - start).cast("int"))

    def masked(blocks):
        def step(state, s):
            fresh = (s["start"] >= state["at"]) | state["first"]
            return F.struct(F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.lit(False).alias("first")).alias("state"), F.when(fresh, cut(blocks, state["at"], s["start"])).alias("out"))

        parts = scan(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("first")), step, "string")
        return F.array_join(F.concat(parts, F.array(cut(blocks, F.array_max(F.transform(spans, lambda s: s["stop"])), F.length(text).cast("bigint")))), mark)

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / F.lit(size)).cast("int")), lambda b: F.substring(text, b * size + 1, F.lit(size)))
    return F.when(F.size(spans) > 0, let(blocks, masked)).otherwise(text)
