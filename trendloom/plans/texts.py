"""Queries over texts, URLs, payloads and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text, values
from ..operators import similarity, tables
from ..sources import files
from .registry import posts, query, r6, table

STOP = "['" + "', '".join(text.STOP_WORDS) + "']"


def tokens_sql(column: str) -> str:
    clean = f"regexp_replace(regexp_replace(regexp_replace(lower({column}), 'https?:\\S+', ' ', 'g'), '\\$[a-z0-9]+', ' ', 'g'), '[^a-z0-9\\s'']', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({clean}, '\\s+'), lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w))"


@query("SELECT p_partkey, [upper(split_part(p_name, ' ', 1)), upper(split_part(p_name, ' ', 2))] AS x FROM part")
def cashtags(spark, sf_dir):
    """F1, F2 over posts made of part names."""
    p = table(spark, sf_dir, "part")
    post = F.concat(F.lit("buy $"), F.replace("p_name", F.lit(" "), F.lit(" and $")), F.lit(" now $"), F.replace("p_name", F.lit(" "), F.lit(" $")), F.lit(" $1x"))
    return p.select("p_partkey", text.cashtags(post).alias("x"))


@query("SELECT p_partkey, p_name || ' via' AS clean, replace(p_name, ' ', '-') AS slug FROM part")
def noise_and_slugs(spark, sf_dir):
    """Links, handles, tags and the author's words go."""
    p = table(spark, sf_dir, "part")
    post = F.concat(F.lit("https://t.co/ab1 "), F.col("p_name"), F.lit(" #tag @someone $COIN via brandful"))
    return p.select("p_partkey", text.strip_noise(post, F.lit("@Brandful")).alias("clean"), text.slugify(F.col("p_name")).alias("slug"))


@query(f"SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS tokens, len({tokens_sql('text')})::BIGINT AS n FROM benchmark")
def tokenize(spark, sf_dir):
    """F5."""
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(f", t AS (SELECT platform, unnest({tokens_sql('text')}) AS token FROM posts) SELECT platform, token, count(*) AS n FROM t GROUP BY ALL", "posts")
def token_frequency(spark, sf_dir):
    """A46's word counts over all posts."""
    return posts(spark, sf_dir).select("platform", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("platform", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f", t AS (SELECT narrative_id, post_id, {tokens_sql('text')} AS w FROM posts), b AS (SELECT narrative_id, post_id, unnest(range(1, len(w))) AS i, w FROM t), c AS (SELECT narrative_id, w[i] || ' ' || w[i + 1] AS phrase, count(*) AS n, min((post_id, i)) AS first FROM b GROUP BY ALL) SELECT narrative_id, phrase, n FROM c QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY n DESC, first) = 1", "posts")
def dominant_bigrams(spark, sf_dir):
    """Each narrative's most frequent pair of words."""
    return tables.dominant_phrases(posts(spark, sf_dir), ["narrative_id"], text.tokens(F.col("text")), "post_id")


PAIRS = f"t AS (SELECT conv_id * 1000 + turn AS id, list_distinct({tokens_sql('text')}) AS w FROM conversations)"


@query(f"WITH {PAIRS}, n AS (SELECT * FROM t WHERE len(w) > 0), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb FROM n a JOIN n b ON a.id < b.id) SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS overlap FROM p WHERE shared / (na + nb - shared) >= 0.28")
def keyword_overlap_pairs(spark, sf_dir):
    """F6, J12 over all turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    rows = similarity.token_rows(turns, "id", text.tokens(F.col("text")))
    return similarity.overlap_pairs(rows, "id").select("a", "b", "shared", r6("overlap"))


@query(f"WITH t AS (SELECT item_id AS id, unnest({tokens_sql('text')}) AS token FROM benchmark), c AS (SELECT id, token, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM c) SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.token = b.token AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.1")
def tf_cosine_pairs(spark, sf_dir):
    """F32, J12 over the benchmark's items."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    v = similarity.tf_vectors(similarity.token_rows(items, "id", text.tokens(F.col("text"))), "id")
    out = similarity.cosine_pairs(v.withColumnRenamed("id", "a"), "a", v.withColumnRenamed("id", "b"), "b", 0.1, F.col("a") < F.col("b"))
    return out.select("a", "b", r6("cosine"))


@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), s AS (SELECT e.vec_id, e.label, sum(e.x * c.m) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.m * c.m))) AS cosine FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY ALL) SELECT label, count(*) AS n, round(avg(cosine), 6) AS mean_cosine, round(min(cosine), 6) AS least FROM s GROUP BY label")
def label_centroid_similarity(spark, sf_dir):
    """F32 over dense vectors: cosine of each vector with its label's centroid.

    Components are averaged with partial sums, so that only a label's means are shuffled; vectors stay whole and meet their
    label's one array of means.
    """
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    s = e.where(F.size("v") > 0).join(c, "label").select("label", (dot("v", "c") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("c", "c")))).alias("cosine"))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.round(F.min("cosine"), 6).alias("least"))


HTML = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({HTML}) AS digest, length({HTML})::BIGINT AS n FROM pages")
def html_strip(spark, sf_dir):
    """F19."""
    t = text.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query("WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.com/a/status/' || page_id WHEN 1 THEN 'https://www.tiktok.com/@a/video/' || page_id WHEN 2 THEN url ELSE 'nothing' END AS u FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'tt' WHEN 2 THEN 'web' END AS platform, CASE WHEN page_id % 4 < 2 THEN page_id::VARCHAR END AS post FROM u")
def url_platform(spark, sf_dir):
    """F18."""
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat(F.lit("https://x.com/a/status/"), "page_id")).when(k == 1, F.concat(F.lit("https://www.tiktok.com/@a/video/"), "page_id")).when(k == 2, F.col("url")).otherwise("nothing")
    return table(spark, sf_dir, "pages").select("page_id", text.platform_of_url(u).alias("platform"), text.post_id_of_url(u).alias("post"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def json_props_agg(spark, sf_dir):
    """S10's access to payload fields."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT event_id AS id, 'x' AS platform, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || user_id END AS handle, CAST(json_extract(props, '$.k') AS BIGINT) AS views, epoch_us(ts) // 1000000 * 1000 AS posted_at FROM events")
def parse_landed_posts(spark, sf_dir):
    """Landed JSON lines, made of events, parsed into canonical posts."""
    e = table(spark, sf_dir, "events")
    author = F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("u"), "user_id")).alias("userName"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("text"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.get_json_object("props", "$.k").cast("long").alias("viewCount"), author.alias("author")))
    p = files.parse_x_posts(e.select(line.alias("value")))
    return p.select(F.col("platform_post_id").cast("long").alias("id"), "platform", "handle", "views", "posted_at")


@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN p_name[1:7] || '…' ELSE p_name END AS name, p_brand AS brand, p_size::VARCHAR AS size FROM part")
def sheet_export(spark, sf_dir):
    """S19."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return p.select("p_partkey").join(files.sheet(p.withColumn("k", F.col("p_partkey")), ["k", "name", "brand", "size"], 8).withColumn("p_partkey", F.col("k").cast("long")).drop("k"), "p_partkey")


@query("WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '' AS filled, CASE WHEN lower(trim(role)) = 'user' THEN 'unclear' WHEN role = '' THEN 'missing' ELSE 'unclear' END AS label, CASE WHEN turn >= 12 THEN 'late' WHEN turn >= 3 THEN 'mid' ELSE 'early' END AS phase FROM t")
def turn_labels(spark, sf_dir):
    """F38, F43 over turns."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "").alias("filled"), values.ternary(F.col("role")).alias("label"), gates.timing_phase(F.lit(False), F.col("turn"), F.lit(False), F.lit(0)).alias("phase"))


@query("WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, len(t)::BIGINT AS n, array_to_string(list_transform(t, lambda x: x.role), '>') AS roles FROM c")
def embedded_turns(spark, sf_dir):
    """Parents with their children as arrays."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    out = tables.embed_children(c.select("conv_id").distinct(), c, "conv_id", "t", ["turn"])
    return out.select("conv_id", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"))


@query(f"WITH t AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark), u AS (SELECT item_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), d AS (SELECT item_id, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(x) DESC, x) AS k FROM d) SELECT item_id, string_agg(x, ' ' ORDER BY k) AS term FROM r WHERE k <= 3 GROUP BY item_id")
def trend_terms(spark, sf_dir):
    """F15."""
    return table(spark, sf_dir, "benchmark").select("item_id", text.trend_term(text.tokens(F.col("text"))).alias("term")).where("term <> ''")


@query("WITH RECURSIVE f AS (SELECT p_partkey, p_name, 0 AS i, 0::BIGINT AS h FROM part UNION ALL SELECT p_partkey, p_name, i + 1, (h * 31 + ascii(p_name[i + 1])) % 4294967296 FROM f WHERE i < length(p_name)) SELECT p_partkey, h AS seed FROM f WHERE i = length(p_name)")
def string_seeds(spark, sf_dir):
    """the 31-hash, folded over characters."""
    return table(spark, sf_dir, "part").select("p_partkey", text.hash31(F.col("p_name"), signed=False).alias("seed"))


@query("SELECT event_id, CASE WHEN value >= 100 THEN 'short' ELSE 'long' END AS kind, floor(value + 0.5)::BIGINT AS rounded, CASE WHEN user_id % 2 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS posted_at FROM events")
def scalar_values(spark, sf_dir):
    """seconds and milliseconds of posting, rounding half up."""
    e = table(spark, sf_dir, "events")
    ms = values.millis(F.col("ts"))
    raw = F.when(F.col("user_id") % 2 == 0, F.floor(ms / 1000).cast("string")).otherwise(ms.cast("string"))
    return e.select("event_id", F.when(F.col("value") >= 100, "short").otherwise("long").alias("kind"), values.js_round(F.col("value")).alias("rounded"), values.normalize_posted_at(raw).alias("posted_at"))


def _counted(name: str, source: str) -> str:
    return f"{name} AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('text')}) AS token FROM {source}) GROUP BY ALL), {name}s AS (SELECT id, count(*) AS n, sqrt(sum(tf * tf)) AS l FROM {name} GROUP BY id)"


@query(
    f"WITH p AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), m AS (SELECT item_id AS id, text FROM benchmark), {_counted('pt', 'p')}, {_counted('mt', 'm')}, "
    "o AS (SELECT pt.id AS post, mt.id AS member, count(*) AS k FROM pt JOIN mt ON pt.token = mt.token GROUP BY ALL), "
    "ov AS (SELECT post, member % 20 AS g, max(k / (a.n + b.n - k)) AS score FROM o JOIN pts a ON a.id = post JOIN mts b ON b.id = member GROUP BY ALL HAVING max(k / (a.n + b.n - k)) >= 0.1), "
    "cw AS (SELECT mt.id % 20 AS g, token, sum(tf / l) AS w FROM mt JOIN mts ON mt.id = mts.id GROUP BY ALL), cl AS (SELECT g, sqrt(sum(w * w)) AS l FROM cw GROUP BY g), "
    "co AS (SELECT pt.id AS post, cw.g, sum(tf / pts.l * w / cl.l) AS score FROM pt JOIN pts ON pt.id = pts.id JOIN cw ON pt.token = cw.token JOIN cl ON cw.g = cl.g GROUP BY ALL HAVING sum(tf / pts.l * w / cl.l) >= 0.2), "
    "u AS (SELECT post, g, 'keyword' AS reason, 1 AS kind, score FROM ov UNION ALL SELECT post, g, 'embedding', 2, score FROM co) "
    "SELECT post AS post_id, g AS narrative_id, reason, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY post ORDER BY kind, round(score, 9) DESC, g) = 1")
def narrative_matches(spark, sf_dir):
    """C1 in batch mode: turns of conversations as posts, the benchmark's items as members of narratives."""
    p = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), F.concat(F.lit("c"), "conv_id").alias("handle"), "text")
    m = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("narrative_id"), F.col("item_id").alias("post_id"), F.concat(F.lit("i"), "item_id").alias("handle"), "text")
    return similarity.match_narratives(p, m, keyword=0.1, cosine=0.2).select("post_id", "narrative_id", "reason", r6("score"))


@query(
    f"WITH RECURSIVE {PAIRS}, n AS (SELECT * FROM t WHERE len(w) > 0), e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.28), "
    "c AS (SELECT id AS a, id AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS post_id, min(b) AS narrative_id FROM c GROUP BY a")
def narratives_formed(spark, sf_dir):
    """C1 in batch mode: groups of overlapping turns that matched nothing."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text")
    pairs = similarity.overlap_pairs(similarity.token_rows(turns, "post_id", text.tokens(F.col("text"))), "post_id")
    return similarity.form_narratives(turns, pairs)


#: Turns of conversations as posts of shards, and what each two posts of a shard have in common.
SHARDS = (
    f"z AS (SELECT role || '/' || (conv_id // 100)::VARCHAR AS shard, turn, conv_id * 1000 + turn AS id, 'c' || conv_id AS handle, (length(text) % 100)::DOUBLE AS score, {tokens_sql('text')} AS words FROM conversations), "
    "k AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(words) AS token FROM z) GROUP BY ALL), l AS (SELECT id, count(*) AS n, sqrt(sum(tf * tf)) AS norm FROM k GROUP BY id), "
    "pr AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) / (any_value(la.n) + any_value(lb.n) - count(*)) AS overlap, sum(a.tf * b.tf) / (any_value(la.norm) * any_value(lb.norm)) AS dot FROM k a JOIN k b ON a.token = b.token "
    "JOIN z za ON za.id = a.id JOIN z zb ON zb.id = b.id AND za.shard = zb.shard JOIN l la ON la.id = a.id JOIN l lb ON lb.id = b.id GROUP BY a.id, b.id)")


def shard_posts(spark, sf_dir):
    """Turns of conversations as posts; a shard is a role and a hundred conversations."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.concat_ws("/", "role", F.floor(F.col("conv_id") / 100).cast("string")).alias("shard"), "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), F.concat(F.lit("c"), "conv_id").alias("handle"),
        (F.length("text") % 100).cast("double").alias("score"), text.cashtags(F.col("text")).alias("tags"), text.tokens(F.col("text")).alias("words"))


# Posts follow one another in the recursion; each sees all those before it. No turn has a cashtag.
@query(
    f"WITH RECURSIVE {SHARDS}, p AS MATERIALIZED (SELECT shard, id, handle, row_number() OVER (PARTITION BY shard ORDER BY score DESC, id) AS pos FROM z), "
    "g(shard, pos, id, handle, n, reason, score) USING KEY (shard, pos) AS (SELECT shard, pos, id, handle, id, 'new', 0.0::DOUBLE FROM p WHERE pos = 1 UNION ALL "
    "(WITH q AS (SELECT p.* FROM p JOIN g ON p.shard = g.shard AND p.pos = g.pos + 1), "
    "m AS (SELECT q.shard, q.pos, x.n, max(overlap) FILTER (WHERE overlap >= 0.28) AS o, max(CASE WHEN x.id = x.n AND dot >= 0.42 THEN dot END) AS c, min(x.pos) AS first FROM q JOIN recurring.g x ON x.shard = q.shard LEFT JOIN pr ON pr.a = q.id AND pr.b = x.id GROUP BY ALL HAVING NOT bool_or(x.handle = q.handle)), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY shard, pos ORDER BY o IS NULL, CASE WHEN o IS NULL THEN -c END, first) AS r FROM m WHERE o IS NOT NULL OR c IS NOT NULL) "
    "SELECT q.shard, q.pos, q.id, q.handle, coalesce(h.n, q.id), CASE WHEN h.o IS NOT NULL THEN 'keyword' WHEN h.c IS NOT NULL THEN 'embedding' ELSE 'new' END, coalesce(h.o, h.c, 0.0) FROM q LEFT JOIN h ON h.shard = q.shard AND h.pos = q.pos AND h.r = 1)) "
    "SELECT shard, id AS post_id, n AS narrative_id, reason, round(score, 6) AS score FROM g")
def greedy_narratives(spark, sf_dir):
    """C1, K3 in the order-dependent mode, by role of turn and hundred conversations."""
    return similarity.greedy_cluster(shard_posts(spark, sf_dir), "shard").select("shard", "post_id", "narrative_id", "reason", r6("score"))
