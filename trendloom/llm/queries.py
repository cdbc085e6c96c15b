"""The operators as queries over whole tables, with production parameters; their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, fim, licenses, negatives, packing, preference, quality, secrets, simhash, unigram, urlfilter, warc

#: The rule set of op4: verdict, host and path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4, seed=42)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least_revisit=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed kinds, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", F.col("spans").alias("s"))
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["rank"] < len(secrets.BASE))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("s")).alias("spans"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate class of every vector."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs; all conversations are used."""
    pair, side = preference.even_and_odd(F.col("conv_id"))
    found = preference.format_preferences(preference.gather_turns(table(spark, sf_dir, "conversations"), pair, side))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return found.select("pair_id", "prefix_turns", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, the model's pieces read as a unigram vocabulary, and the count by the model's own merges."""
    return unigram.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again: counts and digests."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, among all vectors; every seventh id has another label."""
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, lambda i: i % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged, and rebuilt from that."""
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(fim.restored(F.col("form"), F.col("output")), "restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, and the licenses that its wording repeats."""
    rows = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.at").cast("long").alias("first_word"), F.array_max("places.at").cast("long").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat("places.label", "found.label")).alias("labels"), F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_warc_round_trip, op3_quality_rules, op4_url_filter, op5_secret_scan, op6_embedding_near_dedup, op7_preference_format, op8_token_counts, op9_byte_bpe,
        op10_best_fit_packing, op11_hard_negatives, op12_fill_in_middle, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    """op1, op3, op5, op8, op9 and op10 need hashes, models or tokenizers that SQL lacks: tests hold them against brute force."""
    op2 = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
    f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b)
    SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(h, 1 + (5 * i)::INT // 4, 2))::INT >> (3 - (5 * i)::INT % 4)) & 31)), 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f ON p.b = f.b"""
    # The pages of the test tables have no canonical links or refreshes, so no verdict comes from an alias there.
    op4 = r"""
    WITH r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
    u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    m AS (SELECT u.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC) AS k FROM u JOIN r
      ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(u.path, substr(r.rule, strpos(r.rule, '/'))))
    SELECT u.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1"""
    # Positions of the loss spans: lengths of all turns before, and of the turn's head.
    op7 = r"""
    WITH t AS (SELECT DISTINCT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    g AS (SELECT pair_id, coalesce(list({'r': role, 't': text} ORDER BY turn, role, text) FILTER (WHERE side = 0), []) AS c, coalesce(list({'r': role, 't': text} ORDER BY turn, role, text) FILTER (WHERE side = 1), []) AS d FROM t GROUP BY pair_id),
    p AS (SELECT pair_id, c, d, coalesce(list_min(list_filter(range(1, least(len(c), len(d)) + 1), lambda i: c[i] <> d[i])) - 1, least(len(c), len(d))) AS n FROM g),
    q AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, d[n + 1:] AS d FROM p)
    SELECT pair_id, n::BIGINT AS prefix_turns,
      array_to_string(list_transform(p, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS prompt,
      array_to_string(list_transform(c, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS chosen,
      array_to_string(list_transform(d, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS rejected,
      array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].r = 'assistant'), lambda i: (coalesce(list_sum(list_transform(c[1:i - 1], lambda y: length(y.r) + length(y.t) + 24)), 0) + length(c[i].r) + 13)::BIGINT
        || ':' || (list_sum(list_transform(c[1:i], lambda y: length(y.r) + length(y.t) + 24)))::BIGINT), ',') AS chosen_mask,
      array_to_string(list_transform(list_filter(range(1, len(d) + 1), lambda i: d[i].r = 'assistant'), lambda i: (coalesce(list_sum(list_transform(d[1:i - 1], lambda y: length(y.r) + length(y.t) + 24)), 0) + length(d[i].r) + 13)::BIGINT
        || ':' || (list_sum(list_transform(d[1:i], lambda y: length(y.r) + length(y.t) + 24)))::BIGINT), ',') AS rejected_mask
    FROM q
    UNION ALL SELECT NULL, 0, '', '', '', '', '' FROM conversations WHERE conv_id IS NULL"""
    op6 = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.l * b.l),
    c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
    SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, (SELECT min(c.b) FROM c WHERE c.a = v.vec_id) AS component_id,
      v.vec_id = (SELECT min(c.b) FROM c WHERE c.a = v.vec_id) AS kept FROM v"""
    op11 = """
    WITH s AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x FROM embeddings),
    v AS (SELECT DISTINCT vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS e FROM s WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS positive_id, list_dot_product(a.e, b.e)::BIGINT AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS k
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    n AS (SELECT a.vec_id AS anchor_id, b.vec_id AS negative_id, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.label <> b.label WHERE a.vec_id % 50 = 0),
    r AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.s DESC, n.negative_id)::INTEGER AS rank, n.negative_id, p.s AS positive_score, n.s AS negative_score
      FROM p JOIN n ON p.anchor_id = n.anchor_id AND p.k <= 5 AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
    SELECT * FROM r WHERE rank <= 3"""
    op12 = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    x AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    # Words and their three followers, of texts and templates; shared ones by offset; offsets merged; words that stand at one of them.
    op13 = f"""
    WITH t AS (SELECT t, label, w, len(w) AS size, CASE WHEN len(w) < 20 THEN 1.0 ELSE 0.8 END AS least FROM (SELECT t, label, {words} AS w FROM (VALUES {templates}) v(t, label, text))),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    tp AS (SELECT t, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM t), dp AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
    tg AS (SELECT *, lead(word, 1) OVER x AS a, lead(word, 2) OVER x AS b, lead(word, 3) OVER x AS c FROM tp WINDOW x AS (PARTITION BY t ORDER BY p)),
    dg AS MATERIALIZED (SELECT *, lead(word, 1) OVER x AS a, lead(word, 2) OVER x AS b, lead(word, 3) OVER x AS c FROM dp WINDOW x AS (PARTITION BY r ORDER BY p)),
    h AS (SELECT r, t, dg.p - tg.p AS o, count(*) AS votes FROM dg JOIN tg ON dg.word = tg.word AND dg.a = tg.a AND dg.b = tg.b AND dg.c = tg.c GROUP BY ALL),
    n AS (SELECT h.*, size, least, o - lag(o) OVER (PARTITION BY r, h.t ORDER BY o) <= least(8, size // 4) AS near FROM h JOIN t ON t.t = h.t),
    g AS (SELECT *, count(*) FILTER (WHERE near IS NOT TRUE) OVER (PARTITION BY r, t ORDER BY o) AS k FROM n),
    s AS (SELECT r, t, k FROM g GROUP BY r, t, k, size, least HAVING sum(votes) + 3 * (count(*) - 1) >= size - 3 - 4 * floor((1 - least) * size + 1e-9)),
    m AS (SELECT s.r, s.t, s.k, count(DISTINCT tp.p) AS hit FROM s JOIN g ON g.r = s.r AND g.t = s.t AND g.k = s.k JOIN tp ON tp.t = s.t JOIN dp ON dp.r = s.r AND dp.p = tp.p + g.o AND dp.word = tp.word GROUP BY ALL),
    f AS (SELECT r, label, hit / size AS share FROM m JOIN t ON t.t = m.t WHERE hit / size >= least - 1e-9),
    y AS (SELECT r, p, CASE WHEN word = 'mit' AND a = 'license' THEN 'mit' WHEN word = 'apache' AND a = 'license' THEN 'apache' ELSE 'gpl' END AS label FROM dg
      WHERE word IN ('mit', 'apache') AND a = 'license' OR word = 'general' AND a = 'public' AND b = 'license'),
    z AS (SELECT r, count(*) AS n, min(p) AS low, max(p) AS high, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM y GROUP BY r),
    e AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT r, label FROM y UNION ALL SELECT r, label FROM f) GROUP BY r), q AS (SELECT r, max(share) AS share FROM f GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(z.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, coalesce(share, 0.0) AS score
    FROM d LEFT JOIN z ON z.r = d.r LEFT JOIN e ON e.r = d.r LEFT JOIN q ON q.r = d.r"""
    return {"op2_warc_round_trip": op2, "op4_url_filter": op4, "op6_embedding_near_dedup": op6, "op7_preference_format": op7, "op11_hard_negatives": op11, "op12_fill_in_middle": op12, "op13_license_scan": op13}
