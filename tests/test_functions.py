"""Hand-computed cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from trendloom.functions import gates, text, values

L = F.lit


def test_cashtags_and_mentions(one):
    assert one(text.cashtags(L("buy $WIF and $wif2 $1x $wif"))) == ["WIF", "WIF2"]
    assert one(text.ticker_mentions(L("$abc, $A $ABCDEFGHIJKL $x1"))) == ["ABC"]
    assert one(text.cashtags(L(None).cast("string"))) == []


def test_noise_handles_tokens(one):
    assert one(text.strip_noise(L("see https://a.b/c t.co/x @joe a@b $WIF #tag end"))) == "see a@b end"
    assert one(text.strip_noise(L("Brandful said so, brandful!"), L("@Brandful"))) == "said so, !"
    assert one(text.handle_tokens(L("@Joe_Smith.x"))) == ["joe_smith.x", "joe", "smith"]
    assert one(text.tokens(L("This giant DRAGON isn't on https://x.y $WIF étang"))) == ["giant", "dragon", "isn't", "tang"]


def test_overlap(one):
    a, b = text.tokens(L("giant flying dragon spotted")), text.tokens(L("giant dragon spotted london"))
    assert one(text.jaccard(a, b)) == pytest.approx(0.6)
    assert one(text.jaccard(a, text.tokens(L("")))) == 0.0
    assert one(text.bigrams(a)) == ["giant flying", "flying dragon", "dragon spotted"]
    assert one(text.bigrams(text.tokens(L("giant")))) == []


def test_titles_and_slugs(one):
    assert one(text.first_clause_title(L("a GIANT dragon. was seen"))) == "A Giant Dragon"
    assert one(text.first_clause_title(L("https://x.y"))) == "Viral Story"
    assert one(text.slugify(L(" Hello, World! "))) == "hello-world"
    assert one(text.slugify(L("!!!"))) == "cluster"
    assert len(one(text.blurb(L("word " * 60)))) == 119
    assert one(text.title_is_noise(L("by joe"), F.array(L("joe")))) and not one(text.title_is_noise(L("joey"), F.array(L("joe"))))


def test_hashes(one):
    def h31(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h

    for s in ("", "a", "post-123456789", "z" * 50):
        assert one(text.hash31(L(s), signed=False)) == h31(s)
        assert one(text.hash31(L(s))) == (h31(s) ^ 0x80000000) - 0x80000000
    assert one(text.base36(L(1295))) == "zz"


def test_tickers_and_names(one):
    assert one(text.normalize_ticker(L("$wif"))) == "WIF"
    assert one(text.normalize_ticker(L("w1f"))) is None
    assert one(text.is_generic_ticker(L("moon"))) and not one(text.is_generic_ticker(L("WIF")))
    assert one(text.is_sentence_ticker(L("SHOULDBE"), L("a cat"))) and not one(text.is_sentence_ticker(L("SHOULDBE"), L("it should be")))
    assert one(text.nameability_capped(L(0.9), L("MOON"), L("x"))) == 0.3
    assert one(text.nameability_capped(L(0.9), L("WIF"), L("x"))) == 0.9
    reason = lambda name, ticker: one(text.name_reject_reason(L(name).cast("string"), L(ticker).cast("string")))
    assert reason(None, None) == "missing ticker and name"
    assert reason("Moon", "MOON") == "generic ticker $MOON"
    assert reason("test coin", "WIF") == "spam name pattern (test coin)"
    assert reason("ab", "WIF") == "name too short"
    assert reason("the coin", "WIF") == "no identifiable subject in name/ticker"
    assert reason("Peanut Squirrel", "PNUT") is None
    assert one(text.distinctive_words(L("the Peanut peanut squirrel"), L("PNUT"))) == ["pnut", "peanut", "squirrel"]
    assert one(text.subject_entity(L(None), L(" "), L(None), L("see elephants run"), L("@x"))) == "elephants"


def test_signals(one):
    assert one(text.proposal_count(L("someone deploy $ABC, make a coin"))) == 3
    assert one(text.is_pickup(L("on Solana now"))) and not one(text.is_pickup(L("a dragon")))
    mint = "So11111111111111111111111111111111111111112"
    assert one(text.mentions_own(L(f"ca {mint}"), L(mint))) and one(text.mentions_wrong(L(f"ca {mint}"), L("x")))


def test_urls_and_html(one):
    assert one(text.post_id_of_url(L("https://x.com/a/status/12?s=1"))) == "12"
    assert one(text.platform_of_url(L("https://www.TikTok.com/@a/video/5"))) == "tt"
    assert one(text.platform_of_url(L("https://notx.com/"))) == "web"
    assert one(text.strip_html(L("<p>a &amp;lt; b</p><script>x<y</script> c"))) == "a &lt; b c"
    assert one(text.ipfs_url(L("ipfs://abc/1.png"))) == "https://ipfs.io/ipfs/abc/1.png"
    assert one(text.trend_term(F.array(*map(L, ["cccc", "bbbbbb", "aaaa", "bbbbbb", "ddddd"])))) == "bbbbbb ddddd aaaa"
    assert one(text.title_words(L("Watch the 'giant' sea-dragon of $WIF"))) == ["giant", "sea-dragon"]


@pytest.mark.parametrize("value,want", [("1700000000", 1700000000000), ("1700000000000", 1700000000000), ("0", None), ("", None), ("2024-01-01T00:00:00Z", 1704067200000), ("junk", None)])
def test_posted_at(one, value, want):
    assert one(values.normalize_posted_at(L(value))) == want


def test_numbers(one):
    assert one(values.js_round(L(-2.5))) == -2 and one(values.js_round(L(2.5))) == 3
    assert one(values.engagement_rate(L(10), L(5), L(1), L(1000))) == pytest.approx(0.021)
    assert one(values.engagement_rate(L(10), L(5), L(1), L(0))) is None
    assert one(values.parse_count(L("1.2K"))) == 1200 and one(values.parse_count(L("3m"))) == 3_000_000 and one(values.parse_count(L("x"))) is None
    assert [one(values.format_count(L(n))) for n in (999, 1234, 12345, 2_000_000, 25_400_000)] == ["999", "1.2K", "12K", "2M", "25M"] and one(values.format_usd(L(2_500_000))) == "$2.50M"
    assert one(values.format_rate(L(1500.0))) == "1.5k/min" and one(values.format_rate(L(None).cast("double"))) == "—"
    assert one(values.format_age(L(59))) == "59m" and one(values.format_age(L(120))) == "2h" and one(values.format_age(L(1440))) == "1d"
    assert [one(values.ternary(L(v).cast("string"))) for v in ("Y", "0", "?", "maybe", "", None)] == ["yes", "no", "unclear", "unclear", "missing", "missing"]
    assert one(values.number(L("1e3"))) == 1000.0 and one(values.number(L("NaN"))) is None
    assert one(values.model_reply(L('```json\n{"meme_score": 1.4, "suggested_ticker": "WIF"}\n```')))["score"] == 1.0
    assert one(values.within_max_age(L(None).cast("long"), 10, L(10**9))) is False and one(values.within_max_age(L(None).cast("long"), 0, L(10**9))) is True
    assert one(values.age_minutes(L(120_000), L(60_000))) == 0.0
    assert one(values.timeframe_seconds(L("4H"))) == 14400 and one(values.timeframe_seconds(L("2m"))) == 3600
    assert one(values.quote_kind(L("usdc"))) == "stable"
    assert one(values.token_cost(L(1_000_000), L(0), L(None).cast("long"), L(1_000_000))) == 6.75
    assert one(values.safety(L(None), L("x"), L(None).cast("boolean"), L(96), L(12.5))) == (True, False, True, 12.5)


GATE = dict(views=300_000, meme=0.9, velocity=5.0, platforms=["x"], age=10.0, authors=1, av=0.0, proposals=0, pickup=False, unreliable=False)
CASES = [
    (dict(age=721.0), "too_old"), (dict(views=199_999), "below_views"), (dict(meme=0.69, proposals=2), "low_meme"), (dict(meme=0.1, proposals=3), "eligible"),
    (dict(platforms=["tt"], unreliable=True), "no_replication"), (dict(platforms=["tt"], unreliable=True, pickup=True), "eligible"), (dict(platforms=["tt"], authors=2, velocity=0.0), "eligible"),
    (dict(velocity=0.0, authors=2), "no_velocity"), (dict(velocity=0.0, av=1.0, authors=3), "eligible"), (dict(velocity=0.0, pickup=True, authors=2), "eligible"), (dict(age=None), "eligible"),
]


@pytest.mark.parametrize("change,want", CASES)
def test_gate_reason(one, change, want):
    g = GATE | change
    got = gates.gate_reason(L(g["views"]), L(g["meme"]), L(g["velocity"]), F.array(*map(L, g["platforms"])), L(g["age"]).cast("double"), L(g["authors"]), L(g["av"]), L(g["proposals"]), L(g["pickup"]), tt_unreliable=L(g["unreliable"]))
    assert one(got) == want


def test_gates(one):
    assert one(gates.lifecycle(L(400.0), L(200.0))) == "heating" and one(gates.lifecycle(L(400.0), L(-100.0))) == "cooling" and one(gates.lifecycle(L(None).cast("double"), L(None).cast("double"))) == "peaking"
    assert one(gates.bought_reach(L(20000), L(0.004))) and not one(gates.bought_reach(L(9999), L(0.001))) and not one(gates.bought_reach(L(20000), L(None).cast("double")))
    minimum = lambda *p: one(gates.meme_minimum(F.array(*map(L, p))))
    assert (minimum("x"), minimum("tt"), minimum("x", "tt")) == (0.7, 0.75, 0.6)
    assert one(gates.effective_floor(L(100), L(30), L(100), L(100))) == 50
    o = lambda m, liq, cap, dead: one(gates.outcome(L(m), L(liq), L(cap), L(dead)))
    assert (o(5.0, 0.0, 60000.0, False), o(5.0, 0.0, 60000.0, True), o(1.2, 0.0, 0.0, False)) == ("winner", "ignored", "loser")
    assert [one(gates.score_band(L(s), [0.0, 0.5, 1.01])) for s in (0.0, 0.5, 1.0, 2.0)] == [0, 1, 1, None]
    assert one(gates.vision_gate(L(10), L(200_000), L("nice"), L(2))) == "replication" and one(gates.vision_gate(L(None).cast("int"), L(200_000), L("nice"), L(2))) == "too_old"
    assert one(gates.organic_score(L(0.5), L(2), L(3), L(25000.0), L(True), L(5.0))) == 100
    phase = lambda age, token, cap: one(gates.timing_phase(L(False), L(age), L(token), L(cap)))
    assert (phase(2, False, 0), phase(5, False, 0), phase(13, False, 0), phase(1, True, 900_000), phase(1, True, 1), phase(17, True, 1)) == ("early", "mid", "late", "late", "early", "mid")
    assert one(gates.trend_score(L(300.0), L(100.0), L(4800), L(85.0), L(-5.0))) == pytest.approx(0.85)
    assert one(gates.cohort(L("b"), L("a"), ["a", "b"])) == "b" and one(gates.cohort(L("z"), L(None).cast("string"), ["a", "b"])) == "a"


def test_match_confidence(one):
    mint, other = "So11111111111111111111111111111111111111112", "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB"
    post = lambda t, views=600_000: dict(text=L(t), posted_ms=L(0), views=L(views), media=L(None).cast("string"), followers=L(0))
    token = dict(ticker=L("PNUT"), name=L("Peanut Squirrel"), mint=L(mint), launch_ms=L(60_000))
    good = one(gates.match_confidence(post(f"peanut squirrel $pnut {mint}"), token))
    assert good["score"] == 1.0 and "mint in post" in good["reasons"] and not good["wrong_address"]
    bad = one(gates.match_confidence(post(f"$pnut {other}"), token))
    assert bad["wrong_address"] and bad["score"] <= 0.2
    assert one(gates.match_confidence(post("$pnut peanut squirrel", 20_000), token))["score"] <= 0.34


def test_seed_and_hit_matches(one):
    mint, short = "A" * 40, "A" * 20
    pair = lambda q, m=short: one(text.pair_matches(F.lit("$wif"), F.lit("Dog Hat"), F.lit(m), F.lit(q)))
    assert [pair(q) for q in ("WIF", " hat ", "aa", "a", "", None, "cat")] == [True, True, True, False, False, False, False]
    assert pair("a", mint) and not pair("b", mint)
    hit = lambda t, n="Dog Hat": one(text.hit_matches(F.lit("WIF"), F.lit(n), F.lit(t)))
    assert [hit(t) for t in ("$wif", "dog", "dog ha", "", None)] == [True, False, True, False, False]
    assert hit("dogs", None) is False
