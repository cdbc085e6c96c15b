"""Similarity of posts and narratives: keyword overlap, sparse cosine, and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import kept

KEYWORD, COSINE = 0.28, 0.42
#: Longs of a token set's signature.
SIGNATURE = 16
#: Up to so many pairs of rows that share a token, for each row of the posts, posts and members are compared without a filter.
FEW = 8


def token_rows(docs: DataFrame, key: str, words) -> DataFrame:
    """(key, token, tf, size): distinct tokens with their counts, and how many distinct ones the document has."""
    rows = docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key)))


def in_tiles(left: DataFrame, a: str, right: DataFrame, b: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """left and right, to be joined by (token, ta, tb): the rows of a token of more than `tile` of them on a side are dealt to
    tiles by their key, and each tile of one side meets each of the other, so that no token is one task."""
    count = lambda rows, n: rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(n))
    hot = count(left, "ga").join(count(right, "gb"), "token").where("ga > 1 or gb > 1")

    def dealt(rows, key, own, other):
        r = rows.join(hot, "token", "left").withColumn(f"t{own}", F.pmod(F.xxhash64(key), F.coalesce(f"g{own}", F.lit(1))).cast("int"))
        return r.withColumn(f"t{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"g{other}", F.lit(1)) - 1))).drop("ga", "gb")

    return dealt(left, a, "a", "b"), dealt(right, b, "b", "a")


def signature(words: int = SIGNATURE) -> list:
    """Aggregates of a set's rows, longs of 64 * words bits in all, of which each token sets the one that it hashes to."""
    h = F.xxhash64("token")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))
    return [F.bit_or(F.when(F.pmod(h, F.lit(words)) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(words)]


def overlap_candidates(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float = KEYWORD, tile: int = 4096, same: bool = False) -> DataFrame:
    """(a, b): pairs of sets(key, token, size, pos, s0, s1, ...) that may overlap by the threshold, all such pairs among them.

    pos numbers a set's tokens from 1, from rare to common ones, in one order for all sets. Two sets of that overlap share one
    of the first size - ceil(t * size) + 1 tokens of each. They share as many as ceil(t / (1 + t) * (na + nb)), so that their
    first shared token has that many left from its place on in both; and their sizes aren't further apart than the threshold.
    Tokens that only one of them has are as many at least as their signatures' differing bits, which leaves few pairs that
    merely share a common token. same: both sides are the same rows; the smaller set of a pair is b, and there fewer tokens do.
    """
    least = lambda n, t=threshold: n * t - 1e-9  # noqa: E731  (products such as 25 * 0.28 come out a trifle too large)
    share = threshold / (1 + threshold)
    words = [c for c in left.columns if c[0] == "s" and c[1:].isdigit()]

    def prefix(s, key, own, t):
        named = [F.col(c).alias(f"{c}{own}") for c in words]
        return s.where(F.col("pos") <= F.col("size") - F.ceil(least(F.col("size"), t)) + 1).select(key, "token", F.col("size").alias(f"n{own}"), F.col("pos").alias(f"i{own}"), *named)

    pa, pb = in_tiles(prefix(left, a, "a", threshold), a, prefix(right, b, "b", 2 * share if same else threshold), b, tile)
    na, nb, ia, ib = (F.col(c) for c in ("na", "nb", "ia", "ib"))
    order = (na > nb) | ((na == nb) & (F.col(a) < F.col(b))) if same else na >= least(nb)
    rest = 1 + F.least(na - ia, nb - ib) >= (na + nb) * share - 1e-9
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in words), F.lit(0))
    found = pa.join(pb, ["token", "ta", "tb"]).where(order & (nb >= least(na)) & rest & (na + nb - apart >= (na + nb) * (2 * share) - 1e-9))
    return found.select(a, b)


def overlap_join(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float = KEYWORD, same: bool = False, tile: int = 4096) -> DataFrame:
    """(a, b, shared, overlap): pairs of a row of left and one of right of a Jaccard overlap of at least the threshold.

    An inverted-index join in the manner of prefix, positional and bitmap filters, see overlap_candidates. Candidates are then
    counted on all their tokens. The commonest tokens, whose lists are longest, take part only for sets that have nothing rarer,
    and their lists are joined in tiles of about `tile` rows. same: both sides are the same rows, and only pairs a < b count.
    """
    tokens = left.select("token") if same else left.select("token").union(right.select("token"))
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def sets(rows, key):
        w = Window.partitionBy(key).orderBy("df", "token")
        bits = [c.over(Window.partitionBy(key)).alias(f"s{i}") for i, c in enumerate(signature())]
        return rows.join(freq, "token").select(key, "token", "size", F.row_number().over(w).alias("pos"), *bits)

    def whole(rows, key, words, n):
        """Sets as arrays. As size is a window's over the key, reading it keeps rows dealt by key, and nothing is shuffled anew."""
        return rows.withColumnRenamed(rows.columns[0], key).groupBy(key).agg(F.collect_list("token").alias(words), F.max("size").alias(n))

    sa = sets(left.withColumnRenamed(left.columns[0], a), a)
    sb = sa.withColumnRenamed(a, b) if same else sets(right.withColumnRenamed(right.columns[0], b), b)
    found = overlap_candidates(sa, a, sb, b, threshold, tile, same)
    if same:
        found = found.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    both = found.distinct().join(whole(left, a, "wa", "na"), a).join(whole(right, b, "wb", "nb"), b)
    out = both.withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    return out.select(a, b, "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap")).where(F.col("overlap") >= threshold)


def overlap_pairs(rows: DataFrame, key: str, threshold: float = KEYWORD) -> DataFrame:
    """(a, b, shared, overlap) of all pairs a < b of one table, as overlap_join finds them."""
    own = rows.select(key, "token", "size")
    return overlap_join(own, "a", own, "b", threshold, same=True)


def tf_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(key, token, weight): term frequencies scaled to length one, in long form (F32)."""
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key)))
    return rows.select(key, "token", (F.col("tf") / norm).alias("weight"))


def cosine_candidates(a: DataFrame, a_key: str, b: DataFrame, b_key: str, threshold: float = COSINE, tile: int = 4096) -> DataFrame:
    """(a_key, b_key): pairs whose cosine may reach the threshold, all such pairs among them.

    Tokens are ordered from rare to common. Of each vector only the first tokens take part, up to where the rest, by its own
    length and by the other side's largest weights, can't reach the threshold by itself: two vectors that share none of them
    are too far apart. What the shared ones add up to, with the two rests, then has to reach the threshold. A token of many
    vectors is joined in tiles of about `tile` rows of either side.
    """
    least = threshold - 1e-9
    tops = lambda v, n: v.groupBy("token").agg(F.max("weight").alias(n), F.count(F.lit(1)).alias(f"{n}_n"))
    common = tops(a, "ma").join(tops(b, "mb"), "token")
    common = common.select("token", "ma", "mb", (F.col("ma_n") + F.col("mb_n")).alias("df"))

    def prefix(v, key, other):
        w = Window.partitionBy(key).orderBy(F.col("df").desc(), F.col("token").desc()).rowsBetween(Window.unboundedPreceding, 0)
        rest = F.least(F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w)), F.sum(F.col("weight") * F.col(other)).over(w))
        r = v.select(key, "token", "weight").join(common, "token").withColumn("rest", rest)
        return r.withColumn("left", F.coalesce(F.max(F.when(F.col("rest") < least, F.col("rest"))).over(Window.partitionBy(key)), F.lit(0.0))).where(F.col("rest") >= least)

    pa = prefix(a, a_key, "mb").select(a_key, "token", F.col("weight").alias("wa"), F.col("left").alias("ra"))
    pb = prefix(b, b_key, "ma").select(b_key, "token", F.col("weight").alias("wb"), F.col("left").alias("rb"))
    pa, pb = in_tiles(pa, a_key, pb, b_key, tile)
    met = pa.join(pb, ["token", "ta", "tb"])
    near = met.groupBy(a_key, b_key).agg((F.sum(F.col("wa") * F.col("wb")) + F.max("ra") + F.max("rb")).alias("most"))
    return near.where(F.col("most") >= least).select(a_key, b_key)


def cosine_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, threshold: float = COSINE, only=None, tile: int = 4096) -> DataFrame:
    """(a_key, b_key, cosine) of at least the threshold, for vectors of length one in long form.

    Candidates are verified on their whole vectors. only: a condition on the two keys that pairs have to meet. A vector of b
    with many candidates is copied to tiles of about `tile` of them, so that few vectors on that side don't make few tasks.
    """
    found = cosine_candidates(a, a_key, b, b_key, threshold)
    found = kept(found if only is None else found.where(only), "near")
    tiles = found.groupBy(b_key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    whole = lambda v, key, name: v.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias(name))
    copies = whole(b, b_key, "vb").join(tiles, b_key).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    dealt = found.join(tiles, b_key).withColumn("tile", F.pmod(F.xxhash64(a_key), "tiles").cast("int")).drop("tiles")
    both = dealt.join(whole(a, a_key, "va"), a_key).join(copies, [b_key, "tile"])
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))  # a map's values are found by going through it
    dot = F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + F.element_at("va", x) * F.element_at("vb", x))
    return both.select(a_key, b_key, dot.alias("cosine")).where(F.col("cosine") >= threshold)


def products(left: DataFrame, right: DataFrame) -> int:
    """How many pairs of rows share a token."""
    count = lambda rows, n: rows.groupBy("token").agg(F.count(F.lit(1)).alias(n))
    return count(left, "na").join(count(right, "nb"), "token").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0))).first()[0]


def met(left: DataFrame, a: str, right: DataFrame, b: str, tile: int = 4096):
    """All pairs of rows that share a token, by (a, b): what overlap and cosine are added up from without a filter."""
    la, rb = in_tiles(left, a, right, b, tile)
    return la.join(rb, ["token", "ta", "tb"]).groupBy(a, b)


def centroids(vectors: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """(group, token, weight): mean of the members' vectors, scaled to length one (F32)."""
    sums = vectors.join(members.select(key, group), key).groupBy(group, "token").agg(F.sum("weight").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group)))
    return sums.select(group, "token", (F.col("w") / norm).alias("weight"))


def match_narratives(posts: DataFrame, members: DataFrame, keyword: float = KEYWORD, cosine: float = COSINE, few: float = FEW) -> DataFrame:
    """(post_id, narrative_id, reason, score): best narrative of each new post (C1, batch mode).

    posts(post_id, handle, text), members(narrative_id, post_id, handle, text). A shared cashtag comes first, then keyword
    overlap with one member, then cosine with the centroid; the latter two never match a narrative that has the post's
    author. Within a kind the highest score wins, then the smallest narrative_id. Independent of order: posts of one batch
    don't see each other's assignments.

    Words are cut once. Where they lead to few members, at most `few` of them for each word of a post, all that share one are compared, in tiles of a word; filters, which
    have to sort each post's words first, pay only beyond that. Both ways give the same.
    """
    p = posts.select("post_id", "text", "handle", text.normalize_handle(F.col("handle")).alias("h"))
    tags = p.select("post_id", F.explode(text.cashtags(F.col("text"))).alias("tag"))
    member_tags = members.select("narrative_id", F.explode(text.cashtags(F.col("text"))).alias("tag")).distinct()
    by_tag = tags.join(member_tags, "tag").select("post_id", "narrative_id").distinct().select("*", F.lit("cashtag").alias("reason"), F.lit(0).alias("kind"), F.lit(1.0).alias("score"))

    words = text.matching_tokens(F.col("text"), F.col("handle"))
    pt, mt = kept(token_rows(p, "post_id", words), "post_tokens"), kept(token_rows(members.select(F.col("post_id").alias("member_id"), "text", "handle"), "member_id", words), "member_tokens")
    of = members.select(F.col("post_id").alias("member_id"), "narrative_id")
    pv, centers = tf_vectors(pt, "post_id"), centroids(tf_vectors(mt, "member_id"), of, "member_id", "narrative_id")
    if products(pt, mt) <= few * pt.count():
        shared = met(pt.select("post_id", "token", F.col("size").alias("n")), "post_id", mt.select("member_id", "token", F.col("size").alias("m")), "member_id").agg(F.count(F.lit(1)).alias("k"), (F.max("n") + F.max("m")).alias("both"))
        over = shared.select("post_id", "member_id", (F.col("k") / (F.col("both") - F.col("k"))).alias("score")).where(F.col("score") >= keyword)
        dots = met(pv.withColumnRenamed("weight", "w"), "post_id", centers, "narrative_id").agg(F.sum(F.col("w") * F.col("weight")).alias("cosine"))
        near = dots.where(F.col("cosine") >= cosine)
    else:
        over = overlap_join(pt.select("post_id", "token", "size"), "post_id", mt.select("member_id", "token", "size"), "member_id", keyword).withColumnRenamed("overlap", "score")
        near = cosine_pairs(pv, "post_id", centers, "narrative_id", cosine)
    over = over.join(of, "member_id").groupBy("post_id", "narrative_id").agg(F.max("score").alias("score"))
    soft = over.select("post_id", "narrative_id", F.lit("keyword").alias("reason"), F.lit(1).alias("kind"), "score").unionByName(
        near.select("post_id", "narrative_id", F.lit("embedding").alias("reason"), F.lit(2).alias("kind"), F.col("cosine").alias("score")))
    authors = members.select("narrative_id", text.normalize_handle(F.col("handle")).alias("h")).where("h <> ''").distinct()
    soft = soft.join(p.select("post_id", "h"), "post_id").join(authors, ["narrative_id", "h"], "left_anti").drop("h")
    w = Window.partitionBy("post_id").orderBy("kind", F.round("score", 9).desc(), "narrative_id")
    best = by_tag.unionByName(soft).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("post_id", "narrative_id", "reason", "score")


def form_narratives(posts: DataFrame, pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(post_id, narrative_id): connected groups of unmatched posts; a group's id is its smallest post_id (C1, batch mode).

    pairs(a, b) link posts; ids are one orderable type. Rounds of hanging each post's greater neighbours, then each post itself, under its least one end
    in stars; a path of n posts takes about log(n) rounds, and a post with many links is summed up before it is shuffled. Each
    round is a table in the shared folder, so that neither lineage nor cached blocks pile up.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())

    def hung(links, name):
        """Every node's given neighbours, and the node, under the least of them all."""
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return kept(links.join(kept(least, f"{name}_least"), "u"), name)

    now = kept(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    seen = None
    for _ in range(rounds):
        was, seen = seen, state(now)
        if was == seen:
            break
        large = hung(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi")), "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = hung(kept(large, "stars"), "small")
        now = kept(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")).union(small.select("v", "m")).where("hi > lo").distinct(), "links")
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    ids = posts.select("post_id").join(now, posts.post_id == now.hi, "left")
    return ids.select("post_id", F.coalesce("lo", "post_id").alias("narrative_id"))


class OpenNarratives:
    """The open narratives of one shard while a cycle assigns its posts (C1, faithful mode).

    A shared cashtag comes first, with the first such narrative; then the first narrative of which a member's keywords overlap
    enough; then the best cosine with the centroid; the latter two never with the author's own narratives. The centroid of a
    narrative from before is that of its members now, one that the cycle opened keeps its first post's. Words and tags lead
    to narratives by index, so that a post meets those it shares a word with, not all of them.
    """

    def __init__(self, keyword: float, cosine: float):
        self.keyword, self.cosine = keyword, cosine
        self.ids, self.handles, self.fixed, self.squares = [], [], [], []
        self.first_with, self.with_word, self.weights = {}, {}, {}
        self.narrative_of, self.size_of = [], []

    @staticmethod
    def vector(words: list[str]) -> dict[str, float]:
        counts = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        norm = sum(n * n for n in counts.values()) ** 0.5 or 1.0
        return {w: n / norm for w, n in counts.items()}

    def open(self, id_, fixed: bool) -> int:
        self.ids.append(id_)
        self.handles.append(set())
        self.fixed.append(fixed)
        self.squares.append(0.0)
        return len(self.ids) - 1

    def add(self, n: int, handle: str, tags: list[str], words: list[str]) -> None:
        for tag in tags:
            self.first_with[tag] = min(n, self.first_with.get(tag, n))
        if handle:
            self.handles[n].add(handle)
        vec, member = self.vector(words), len(self.narrative_of)
        self.narrative_of.append(n)
        self.size_of.append(len(vec))
        moves = not self.fixed[n] or not self.squares[n]
        for w, v in vec.items():
            self.with_word.setdefault(w, []).append(member)
            if moves:
                at = self.weights.setdefault(w, {})
                old = at.get(n, 0.0)
                at[n] = old + v
                self.squares[n] += at[n] ** 2 - old**2

    def match(self, handle: str, tags: list[str], words: list[str]) -> tuple[int, str, float] | None:
        hits = [self.first_with[t] for t in tags if t in self.first_with]
        if hits:
            return min(hits), "cashtag", 1.0
        vec, shared, dots = self.vector(words), {}, {}
        for w, v in vec.items():
            for m in self.with_word.get(w, ()):
                shared[m] = shared.get(m, 0) + 1
            for n, x in self.weights.get(w, {}).items():
                dots[n] = dots.get(n, 0.0) + v * x
        own = {n for n in {*dots, *(self.narrative_of[m] for m in shared)} if handle and handle in self.handles[n]}
        best = {}
        for m, k in shared.items():
            n, overlap = self.narrative_of[m], k / (len(vec) + self.size_of[m] - k)
            if overlap >= self.keyword and n not in own:
                best[n] = max(overlap, best.get(n, 0.0))
        if best:
            return min(best), "keyword", best[min(best)]
        near = [(x / self.squares[n] ** 0.5, -n) for n, x in dots.items() if n not in own and self.squares[n] > 0]
        top = max(near, default=(0.0, 0))
        return (-top[1], "embedding", top[0]) if top[0] >= self.cosine and top[0] > 0 else None


def clean_handle(handle) -> str:
    return (handle or "").lstrip("@").lower()


def assign_cycle(posts: list[dict], earlier: dict, keyword: float, cosine: float) -> list[tuple]:
    """(post_id, narrative_id, reason, score) of a cycle's posts, by score, then post_id.

    earlier: narrative_id -> members (handle, tags, words) of the open narratives from before, to which members are added;
    they are matched in order of their ids, then those of the cycle as they open, each named by its first post.
    """
    now = OpenNarratives(keyword, cosine)
    for id_ in sorted(earlier):
        n = now.open(id_, False)
        for handle, tags, words in earlier[id_]:
            now.add(n, handle, tags, words)
    out = []
    for p in sorted(posts, key=lambda p: (-p["score"], p["post_id"])):
        member = clean_handle(p["handle"]), list(p["tags"]), list(p["words"])
        n, reason, score = now.match(*member) or (now.open(p["post_id"], True), "new", 0.0)
        now.add(n, *member)
        earlier.setdefault(now.ids[n], []).append(member)
        out.append((p["post_id"], now.ids[n], reason, score))
    return out


def greedy_cluster(posts: DataFrame, shard: str, keyword: float = KEYWORD, cosine: float = COSINE, members: DataFrame | None = None) -> DataFrame:
    """(shard, post_id, narrative_id, reason, score): the order-dependent assignment, one shard a task (C1, faithful mode).

    posts(post_id, handle, score, tags, words) and the shard column: a platform and hour, so that a shard's size is bounded by what one
    hour brings. members(shard, narrative_id, post_id, handle, tags, words) are those of narratives open from before. Posts go
    in order of score, then post_id, as OpenNarratives says; a post without a match opens a narrative named by its post_id.
    """

    def run(pdf):
        import pandas as pd

        earlier = {}
        for r in pdf[pdf["narrative_id"].notna()].sort_values(["narrative_id", "post_id"]).itertuples():
            earlier.setdefault(int(r.narrative_id), []).append((clean_handle(r.handle), list(r.tags), list(r.words)))
        found = assign_cycle(pdf[pdf["narrative_id"].isna()].to_dict("records"), earlier, keyword, cosine)
        return pd.DataFrame([(pdf[shard].iloc[0], *row) for row in found], columns=[shard, "post_id", "narrative_id", "reason", "score"])

    kind = dict(posts.dtypes)[shard]
    rows = posts.select(shard, "post_id", "handle", "score", "tags", "words", F.lit(None).cast("long").alias("narrative_id"))
    if members is not None:
        rows = rows.unionByName(members.select(shard, "post_id", "handle", F.lit(0.0).alias("score"), "tags", "words", F.col("narrative_id").cast("long").alias("narrative_id")))
    return rows.groupBy(shard).applyInPandas(run, f"{shard} {kind}, post_id long, narrative_id long, reason string, score double")
