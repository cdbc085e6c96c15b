"""Text as Column expressions: symbols, handles, tokens, titles, URLs and name plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the tokenizer.
STOP_WORDS = """
that this with from have just your what when them then than they will would could should about into after before
there their been being were where which while only also very some more most much like know dont does did not but and
the for you are was has had can all one out get got its our how why who she his her any may way new now too
""".split()

# Further stop words of titles.
TITLE_STOP_WORDS = """
says said viral video watch breaking news story trend trending post posts tweet thread update live real time
""".split()

# Titles that say nothing.
GENERIC_TITLES = ["viral story", "emerging narrative cluster", "cluster"]

# Tickers too general to name a subject.
GENERIC_TICKERS = """
MEME VIRAL THIS NEWS COIN TOKEN CRYPTO SOLANA SOL MOON PUMP LFG CT FYP TREND TRENDING STORY VIDEO TIKTOK POST LATEST
BREAKING UPDATE LIVE NEW HOT FUNNY REAL TRUE FACT GOAT BASED DEGEN ALERT JUST WATCH OMG WTF LOL NAH BRO GUYS HERE THE AND
""".split()

# Words of a name that identify nothing.
GENERIC_NAME_WORDS = """
coin token meme memecoin crypto solana sol pump fun official new the a an and or of on in to for with by from just launched
live real true best top hot viral trend trending moon lfg degen based goat cat dog ai agent bot test v2 v3
""".split()

# Words that betray a ticker cut out of a sentence.
SENTENCE_WORDS = ["someone", "should", "would", "could", "about", "think", "needs"]

# Names and tickers that are spam.
SPAM_PATTERNS = ["(?i)^test", "(?i)^xxx", "(?i)^aaa", "^111", "^000", r"(?i)pepe\d{3,}", r"^\d+$", "^[^a-zA-Z0-9]+$"]

# Phrases that propose a token.
PROPOSAL_PATTERNS = [
    r"someone\s+deploy", r"make\s+a\s+coin", r"this\s+is\s+a\s+coin", r"wen\s+coin", r"needs\s+a\s+ticker",
    r"deploy\s+this", r"coin\s+it", r"tokenize\s+this", r"launch\s+a\s+coin", r"should\s+be\s+a\s+coin",
]

# Signs of crypto talk.
PICKUP_PATTERNS = [
    r"(?i)\bsolana\b", r"(?i)\bmemecoin", r"(?i)\bpump\.fun\b", r"(?i)\bdegen\b", r"\$\w{2,10}\b",
    r"(?i)\bcontract\b", r"(?i)\bca\s*[:=]", r"(?i)\bjup(?:iter)?\b", r"(?i)\bbonk\b", r"(?i)\bpumpfun\b",
]

# Patterns of cashtags and of addresses.
CASHTAG = r"\$([A-Za-z][A-Za-z0-9]{1,9})"
TICKER_MENTION = r"(?i)\$([A-Z]{2,10})\b"
ADDRESS = r"([1-9A-HJ-NP-Za-km-z]{32,44})"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(1))


def cashtags(text: Column) -> Column:
    """Distinct upper-cased cashtags in order of appearance (F1)."""
    return F.array_distinct(F.transform(_all(text, CASHTAG), F.upper))


def ticker_mentions(text: Column) -> Column:
    """Distinct upper-cased letter-only tickers after a dollar sign (F2)."""
    return F.array_distinct(F.transform(_all(text, TICKER_MENTION), F.upper))


def normalize_handle(handle: Column) -> Column:
    """Handle without its @, lower-cased; null as empty."""
    return F.lower(F.regexp_replace(_text(handle), "^@", ""))


def handle_tokens(handle: Column) -> Column:
    """The handle and its alphanumeric parts of three characters or more."""
    h = normalize_handle(handle)
    parts = F.filter(F.split(h, "[^a-z0-9]+"), lambda p: F.length(p) >= 3)
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(h), parts)))


def strip_noise(text: Column, handle: Column | None = None) -> Column:
    """Text without URLs, handles, cashtags, hashtags and the author's own handle words."""
    out = _text(text)
    for pattern in (r"(?i)https?:/\S+", r"(?i)\bt\.co/\S+", r"\B@[A-Za-z0-9_]{1,15}", CASHTAG, "#[A-Za-z0-9_]+"):
        out = F.regexp_replace(out, pattern, " ")
    if handle is not None:
        own = F.transform(F.filter(handle_tokens(handle), lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
        pattern = F.concat(F.lit(r"(?i)\b(?:"), F.array_join(own, "|"), F.lit(r")\b"))
        out = F.when(F.size(own) > 0, F.regexp_replace(out, pattern, F.lit(" "))).otherwise(out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words of four characters or more that are no stop words, repeats included."""
    out = F.lower(_text(text))
    for pattern in (r"https?:\S+", r"\$[a-z0-9]+", r"[^a-z0-9\s']"):
        out = F.regexp_replace(out, pattern, " ")
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(F.split(out, r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(stop))


def matching_tokens(text: Column, handle: Column) -> Column:
    """Tokens of the text without noise and the author's own handle."""
    return tokens(strip_noise(text, handle))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two token arrays' union that both hold; zero if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, F.when(b.isNotNull(), b)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def first_clause_title(text: Column) -> Column:
    """First clause of the cleaned text, eight words at most, in title case, 72 characters at most."""
    clause = F.trim(F.get(F.split(strip_noise(text), "[.!?\n—–-]+"), F.lit(0)))
    words = F.slice(F.filter(F.split(clause, r"\s+"), lambda w: w != ""), 1, 8)
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.when(F.size(words) > 0, F.substring(F.array_join(title, " "), 1, 72)).otherwise("Viral Story")


def blurb(text: Column) -> Column:
    """Cleaned text, cut to 118 characters and an ellipsis beyond 120."""
    clean = strip_noise(text)
    return F.when(F.length(clean) > 120, F.concat(F.substring(clean, 1, 118), F.lit("…"))).otherwise(clean)


def title_is_noise(title: Column, author_tokens: Column) -> Column:
    """A title is noise if it is missing, holds an @ or one of the author's words."""
    words = F.split(F.lower(title), "[^a-z0-9_]+")
    return title.isNull() | (title == "") | title.contains("@") | F.exists(author_tokens, lambda t: (F.length(t) >= 3) & F.array_contains(words, t))


def slugify(text: Column) -> Column:
    """Lower-case words joined by hyphens, 48 characters at most (F8)."""
    slug = F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", "-")
    slug = F.substring(F.regexp_replace(slug, "^-|-$", ""), 1, 48)
    return F.when(slug == "", "cluster").otherwise(slug)


def hash31(text: Column, bits: int = 32, signed: bool = True) -> Column:
    """The hash 31 * h + code over ASCII characters, wrapped to 32 bits."""
    codes = F.transform(F.filter(F.split(_text(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << bits)))
    return F.when(h >= (1 << (bits - 1)), h - (1 << bits)).otherwise(h) if signed else h


def base36(number: Column) -> Column:
    """A non-negative number in base 36."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def narrative_id(title: Column, first_id: Column) -> Column:
    """Identifier of a narrative: slug of its title and six digits of its first post's hash."""
    return F.concat(F.lit("c-"), slugify(title), F.lit("-"), F.substring(base36(F.abs(hash31(first_id))), 1, 6))


def normalize_ticker(ticker: Column) -> Column:
    """Two to ten capital letters, or null."""
    t = F.upper(F.trim(F.regexp_replace(ticker.cast("string"), r"^\$", "")))
    return F.when(t.rlike("^[A-Z]{2,10}$"), t)


def is_generic_ticker(ticker: Column) -> Column:
    t = normalize_ticker(ticker)
    return t.isNull() | F.coalesce(t.isin(GENERIC_TICKERS), F.lit(False))


def is_sentence_ticker(ticker: Column, text: Column) -> Column:
    """A ticker that isn't in the text's run-together words and holds a common word of sentences."""
    t = F.lower(normalize_ticker(ticker))
    joined = F.regexp_replace(F.lower(_text(text)), r"\s+", "")
    common = F.lit(False)
    for w in SENTENCE_WORDS:
        common = common | t.contains(w)
    return F.coalesce((F.length(t) > 3) & (_text(text) != "") & ~joined.contains(t) & common, F.lit(False))


def nameability_capped(score: Column, ticker: Column, text: Column, cap: float = 0.3) -> Column:
    """Score, held to the cap if the ticker names no subject."""
    unnamed = is_generic_ticker(ticker) | is_sentence_ticker(ticker, text)
    return F.when(unnamed, F.least(F.coalesce(score, F.lit(0.0)), F.lit(cap))).otherwise(score)


def name_words(name: Column) -> Column:
    """Words of a name, three characters or more, that aren't generic."""
    words = F.split(F.regexp_replace(_text(name), r"[^\w\s]", " "), r"\s+")
    return F.filter(F.transform(words, F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_NAME_WORDS))


def distinctive_words(name: Column, ticker: Column) -> Column:
    """Up to five distinct name words, led by a ticker of four letters or more that isn't generic."""
    t = normalize_ticker(ticker)
    lead = F.when(~is_generic_ticker(ticker) & (F.length(t) >= 4), F.array(F.lower(t))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(lead, name_words(name))), 1, 5)


def name_reject_reason(name: Column, ticker: Column) -> Column:
    """First reason why a token's name is implausible, or null."""
    t, raw = normalize_ticker(ticker), F.trim(_text(name))
    named, symbol = raw != "", t.isNotNull()
    out = F.when(~symbol & ~named, "missing ticker and name").when(symbol & is_generic_ticker(ticker), F.concat(F.lit("generic ticker $"), t))
    for pattern in SPAM_PATTERNS:
        out = out.when(named & raw.rlike(pattern), F.concat(F.lit("spam name pattern ("), raw, F.lit(")")))
        out = out.when(symbol & F.coalesce(t.rlike(pattern), F.lit(False)), F.concat(F.lit("spam ticker pattern ($"), t, F.lit(")")))
    subject = (F.size(name_words(name)) >= 1) | F.coalesce((F.length(t) >= 4) & ~is_generic_ticker(ticker), F.lit(False))
    return out.when(named & (F.length(raw) <= 2), "name too short").when(~subject, "no identifiable subject in name/ticker")


def subject_entity(ticker: Column, name: Column, stored: Column, text: Column, handle: Column) -> Column:
    """Subject of a post: its ticker, else its name, else what was stored, else its longest token."""
    words = matching_tokens(text, handle)
    longest = F.aggregate(words, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(normalize_ticker(ticker), filled(name), filled(stored), F.when(longest != "", longest))


def trend_term(words: Column) -> Column:
    """Up to three longest distinct words, joined; words of a length in alphabetical order."""
    ranked = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    return F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["w"]), " ")


def title_words(title: Column) -> Column:
    """Words of a title that may make a search term: three characters or more, no stop words, no quotes around them."""
    clean = F.regexp_replace(F.lower(strip_noise(title)), r"[^a-z0-9\s'-]", " ")
    words = F.transform(F.split(clean, r"\s+"), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS + TITLE_STOP_WORDS))


def proposal_count(text: Column) -> Column:
    """Distinct tickers mentioned plus phrases that propose a token (F16)."""
    hits = F.lit(0)
    for pattern in PROPOSAL_PATTERNS:
        hits = hits + _text(text).rlike(f"(?i){pattern}").cast("int")
    return F.size(ticker_mentions(text)) + hits


def is_pickup(text: Column) -> Column:
    """Whether a text shows signs of crypto talk (F16)."""
    return _text(text).rlike("|".join(f"(?:{p})" for p in PICKUP_PATTERNS))


def normalize_symbol(ticker: Column) -> Column:
    """Upper case without a leading dollar sign or blanks; null as empty."""
    return F.trim(F.regexp_replace(F.upper(_text(ticker)), r"^\$", ""))


def pair_matches(symbol: Column, name: Column, mint: Column, query: Column) -> Column:
    """Whether a pair's symbol, name or address holds the query; one letter only counts within a whole address."""
    q, m = F.lower(F.trim(_text(query))), F.lower(_text(mint))
    anywhere = F.lower(normalize_symbol(symbol)).contains(q) | F.lower(_text(name)).contains(q) | m.contains(q)
    return F.when(q == "", False).when((F.length(m) >= 32) & m.contains(q), True).otherwise((F.length(q) >= 2) & anywhere)


def hit_matches(ticker: Column, name: Column, term: Column) -> Column:
    """Whether a found token is meant by a term: its symbol, or within its name from four letters on."""
    t = F.trim(_text(term))
    return (t != "") & ((normalize_symbol(ticker) == normalize_symbol(t)) | ((F.length(t) >= 4) & F.lower(_text(name)).contains(F.lower(t))))


def addresses(text: Column) -> Column:
    """Distinct base-58 addresses in a text."""
    return F.array_distinct(_all(text, ADDRESS))


def mentions_own(text: Column, mint: Column) -> Column:
    return F.coalesce(F.array_contains(addresses(text), mint), F.lit(False))


def mentions_wrong(text: Column, mint: Column) -> Column:
    return F.coalesce(F.exists(addresses(text), lambda a: a != mint), F.lit(False))


def post_id_of_url(url: Column) -> Column:
    """Number after /status/ or /video/, or null."""
    found = F.regexp_extract(_text(url), r"/(?:status|video)/(\d+)", 1)
    return F.when(found != "", found)


def platform_of_url(url: Column) -> Column:
    """Platform by the URL's host."""
    host = F.lower(F.regexp_extract(_text(url), r"^[a-zA-Z]+://([^/?#]+)", 1))
    return F.when(host.rlike(r"(^|\.)(x|twitter)\.com$"), "x").when(host.rlike(r"(^|\.)tiktok\.com$"), "tt").when(host != "", "web")


def strip_html(html: Column) -> Column:
    """Text of an HTML page: no scripts, styles or tags, five entities decoded, white space folded."""
    out = F.regexp_replace(_text(html), r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ipfs_url(url: Column, gateway: str = "https://ipfs.io/ipfs/") -> Column:
    """ipfs:// and foreign gateways rewritten to one gateway."""
    path = F.regexp_extract(_text(url), r"^(?:ipfs://(?:ipfs/)?|https?://[^/]+/ipfs/)(.+)$", 1)
    return F.when(path != "", F.concat(F.lit(gateway), path)).otherwise(url)
