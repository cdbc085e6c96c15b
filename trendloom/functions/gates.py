"""Scores, gates and classifications as Column expressions. Ordered decisions keep their order."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_pickup, proposal_count


#: Tickers that are ordinary words.
COMMON_TICKERS = ("diary", "hood", "coin", "meme", "baby", "alpha", "sigma", "trend", "viral", "rocky", "paul")


def has(platforms: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(platforms, name), F.lit(False))


def lifecycle(velocity: Column, accel: Column) -> Column:
    """heating, peaking or cooling from velocity and acceleration."""
    v, a = F.coalesce(velocity, F.lit(0.0)), F.coalesce(accel, F.lit(0.0))
    rel = F.when(v > 0, a / v).otherwise(F.signum(a))
    return F.when((v <= 0) & (a <= 0), "peaking").when((rel > 0.12) & (v > 0), "heating").when((rel < -0.07) | (a < -500), "cooling").otherwise("peaking")


def trend_score(volume: Column, mcap: Column, txns: Column, change_24h: Column, change_1h: Column) -> Column:
    """Weighted sum of clamped signals, 0 to 1: turnover, trades, and rises of the day and the hour."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.least(F.coalesce(volume, zero) / F.greatest(F.coalesce(mcap, zero), one) / 3, one) * 0.4 + F.least(F.coalesce(txns, F.lit(0)) / 4800, one) * 0.25
        + F.least(F.greatest(F.coalesce(change_24h, zero), zero) / 85, one) * 0.2 + F.least(F.greatest(F.coalesce(change_1h, zero), zero) / 55, one) * 0.15
    )


def organic_score(avg_meme: Column, n_platforms: Column, n_posts: Column, gain: Column, cross: Column, author_velocity: Column, cross_boost: float = 25.0) -> Column:
    """Weighted, clamped sum, rounded half up, 100 at most."""
    total = (
        F.coalesce(avg_meme, F.lit(0.0)) * 45 + F.least(n_platforms, F.lit(4)) * 8 + F.least(n_posts, F.lit(12)) * 4
        + F.least(gain / 50000, F.lit(1.0)) * 25 + F.when(cross, cross_boost).otherwise(0.0)
        + F.least(F.coalesce(author_velocity, F.lit(0.0)) / 10, F.lit(1.0)) * 30
    )
    return F.floor(F.least(F.lit(100.0), total) + 0.5).cast("long")


def bought_reach(views: Column, rate: Column, min_rate: float = 0.005) -> Column:
    """Many views, little engagement."""
    return F.coalesce((views >= 10_000) & (rate < min_rate), F.lit(False))


def meme_minimum(platforms: Column, x: float = 0.7, tt: float = 0.75, discount: float = 0.1) -> Column:
    """Score a narrative needs, by its platforms."""
    only_tt = has(platforms, "tt") & ~F.exists(platforms, lambda p: p != "tt")
    cross = has(platforms, "tt") & ~only_tt
    return F.when(cross, max(0.0, round(x - discount, 10))).when(only_tt, tt).otherwise(x)


def max_age(platforms: Column, x: int = 720, tt: int = 4320) -> Column:
    """Oldest age in minutes of a narrative's newest post."""
    return F.when(has(platforms, "tt") & ~has(platforms, "x"), tt).otherwise(x)


def gate_reason(views: Column, meme: Column, velocity: Column, platforms: Column, newest_age: Column, authors: Column, author_velocity: Column, proposals: Column, pickup: Column, min_views: float = 200_000, tt_unreliable: Column | None = None) -> Column:
    """First reason that keeps a narrative from display, or eligible.

    Age, then views, then score (bypassed by three proposals), then the rules for narratives of one platform only, then
    velocity. An unknown newest age skips the age test; an unknown velocity is none.
    """
    zero = F.lit(0)
    authors, author_velocity, pickup = F.coalesce(authors, zero), F.coalesce(author_velocity, F.lit(0.0)), F.coalesce(pickup, F.lit(False))
    moving = F.coalesce(velocity > 0, F.lit(False))
    replicated = (authors >= 2) | (author_velocity > 0)
    only_tt = (F.size(platforms) == 1) & has(platforms, "tt")
    unreliable = F.lit(False) if tt_unreliable is None else F.coalesce(tt_unreliable, F.lit(False))
    ok = moving | ((author_velocity > 0) & (authors >= 3)) | (pickup & replicated)
    return (
        F.when(F.coalesce(newest_age > max_age(platforms), F.lit(False)), "too_old")
        .when(F.coalesce(views, zero) < min_views, "below_views")
        .when((F.coalesce(proposals, zero) < 3) & (F.coalesce(meme, F.lit(0.0)) < meme_minimum(platforms)), "low_meme")
        .when(only_tt & unreliable, F.when(replicated | pickup, "eligible").otherwise("no_replication"))
        .when(only_tt & replicated & ~moving, "eligible")
        .when(~ok, "no_velocity").otherwise("eligible")
    )


def vision_gate(age_min: Column, views: Column, text: Column, sound_creators: Column, min_views: int = 100_000, max_age_min: int = 1440, min_creators: int = 2) -> Column:
    """Why a video is or isn't worth scoring; the first rule that fits."""
    return (
        F.when(F.coalesce(age_min > max_age_min, F.lit(True)), "too_old").when(F.coalesce(views, F.lit(0)) < min_views, "below_views")
        .when(is_pickup(text), "ct_pickup").when(proposal_count(text) > 0, "ticker_proposal")
        .when(F.coalesce(sound_creators, F.lit(0)) >= min_creators, "replication").otherwise("no_signal")
    )


def fast_lane(views: Column, age_min: Column, min_views: int = 500_000, max_age_min: int = 120) -> Column:
    """Large and young posts are scored at once."""
    return F.coalesce((views >= min_views) & (age_min <= max_age_min), F.lit(False))


def feed_eligible(platform: Column, age_min: Column, score: Column, views: Column, max_age_x: int = 720, max_age_tt: int = 4320, min_views: int = 0) -> Column:
    """Young enough for its platform and scored high enough."""
    tt = platform == "tt"
    limit = F.when(tt, max_age_tt).otherwise(max_age_x)
    least = F.when(tt, 0.75).otherwise(0.7)
    return F.coalesce((age_min <= limit) & (score >= least) & (views >= min_views), F.lit(False))


def token_floor(liquidity: Column, volume: Column, age_min: Column, price: Column, min_liquidity: float = 1000, min_volume: float = 500, max_age_min: int = 43_200) -> Column:
    """Tokens worth showing."""
    return F.coalesce((liquidity >= min_liquidity) & (volume >= min_volume) & (age_min <= max_age_min) & (price > 0), F.lit(False))


def outcome(multiple: Column, liquidity: Column, mcap: Column, dead: Column, win_multiple: float = 5.0, lose_multiple: float = 2.0, win_usd: float = 50_000) -> Column:
    """winner, loser, or ignored if neither or both."""
    zero = F.lit(0.0)
    win = (F.coalesce(multiple, zero) >= win_multiple) & ((F.coalesce(liquidity, zero) >= win_usd) | (F.coalesce(mcap, zero) >= win_usd))
    lose = (F.coalesce(multiple, zero) < lose_multiple) | F.coalesce(dead, F.lit(False))
    return F.when(win & ~lose, "winner").when(lose & ~win, "loser").otherwise("ignored")


def peak_class(multiple: Column, ran: float = 5.0, fizzled: float = 2.0) -> Column:
    """ran, middle, fizzled or unknown by the peak multiple."""
    return F.when(multiple.isNull(), "unknown").when(multiple >= ran, "ran").when(multiple < fizzled, "fizzled").otherwise("middle")


def strict_winner(multiple: Column, ath_mcap: Column, least: float = 10.0, mcap: float = 250_000) -> Column:
    """P10."""
    return F.coalesce((multiple >= least) & (ath_mcap >= mcap), F.lit(False))


def strict_loser(multiple: Column, trades: Column, most: float = 1.5, least_trades: int = 1) -> Column:
    """P10."""
    return F.coalesce((multiple < most) & (trades >= least_trades), F.lit(False))


def passes_sanity(multiple: Column, mcap: Column, mint: Column, excluded: list[str], most_multiple: float = 10_000, most_mcap: float = 1e10) -> Column:
    """Plausible peak and no excluded address."""
    known = ~mint.isin(excluded) if excluded else F.lit(True)
    return F.coalesce((multiple <= most_multiple) & (mcap <= most_mcap) & known, F.lit(False))


def effective_floor(base: Column, window_min: Column, lane_min: Column, default: Column, floor_min: int = 300, floor_max: int = 100_000) -> Column:
    """Likes floor scaled by the window's length below an hour, within bounds."""
    base = F.greatest(lane_min, F.coalesce(base, default))
    share = F.least(F.greatest(F.coalesce(window_min, F.lit(60)), F.lit(1)) / 60, F.lit(1.0))
    least = F.when(lane_min <= 100, 30).otherwise(floor_min)
    return F.greatest(least, F.least(F.lit(floor_max), F.floor(base * share + 0.5))).cast("long")


def timing_phase(live: Column, age_hours: Column, has_token: Column, mcap: Column) -> Column:
    """live, early, mid or late: by age while there is no token, else by how far that has run."""
    run = F.when(mcap > 800_000, 8).when(mcap > 250_000, 5).when(mcap > 80_000, 3).when(mcap > 20_000, 2).otherwise(1)
    alone = F.when(age_hours < 3, "early").when(age_hours < 12, "mid").otherwise("late")
    led = F.when(run >= 6, "late").when((age_hours < 4) & (run < 3), "early").when((age_hours > 16) | (run >= 3), "mid").otherwise("early")
    return F.when(F.coalesce(live, F.lit(False)), "live").when(F.coalesce(has_token, F.lit(False)), led).otherwise(alone)


def cohort(requested: Column, stored: Column, known: list[str]) -> Column:
    """The requested cohort if it is known, else the stored one, else the first known."""
    return F.when(requested.isin(known), requested).when(stored.isin(known), stored).otherwise(known[0])


def follower_bucket(n: Column) -> Column:
    """A47."""
    return F.when(n < 10_000, "small").when(n < 100_000, "mid").when(n.isNotNull(), "large")


def score_band(score: Column, edges: list[float]) -> Column:
    """Index of the half-open band [edge i, edge i + 1) that holds a score, or null."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((score >= a) & (score < b), i).otherwise(out)
    return out


def match_confidence(
    post: dict[str, Column], token: dict[str, Column], min_viral: int = 50_000, synonyms: dict[str, list[str]] | None = None, stories: list[dict] | None = None, accounts: list[dict] | None = None, common: tuple[str, ...] = COMMON_TICKERS
) -> Column:
    """struct(score in 0..1, reasons, wrong_address) of a post as the source of a token.

    post: text, posted_ms, views, media, followers and, for accounts, handle. token: ticker, name, mint, launch_ms. Every rule adds or takes points;
    a foreign address caps the score at 0.2, few views without the token's own address at 0.34.

    What names persons and events is the caller's to give: synonyms (a word of the name -> what a text may say for it); stories, each
    {reason, points, name: words that the name has, text: words that the text has, any: one of which it has, followers: at least},
    all but the first two optional; accounts, each {reason, points, handle, text: words that the text has}; common: tickers
    that are ordinary words and count only with their sign.
    """
    from .text import mentions_own, mentions_wrong, name_words

    text, views = F.lower(F.coalesce(post["text"], F.lit(""))), F.coalesce(post["views"], F.lit(0))
    ticker, name = F.lower(F.regexp_replace(F.coalesce(token["ticker"], F.lit("")), r"^\$", "")), F.lower(F.coalesce(token["name"], F.lit("")))
    own, foreign = mentions_own(post["text"], token["mint"]), mentions_wrong(post["text"], token["mint"])
    late = (post["posted_ms"] - token["launch_ms"]) / 60_000
    signed = text.contains(F.concat(F.lit("$"), ticker))
    ticker_hit = (ticker != "") & (signed | (~ticker.isin(*common) & text.contains(ticker)) if common else text.contains(ticker))
    wrong = F.coalesce(ticker_hit & foreign, F.lit(False))
    words = name_words(token["name"])
    rules = [
        (late <= 0, 0.15, "posted before launch"), ((late > 0) & (late <= 60), 0.05, "posted within 1h of launch"),
        (late > 60, -0.35, "posted after launch"), (own, 0.4, "mint in post"), (wrong, -0.6, "wrong address in post"),
        (ticker_hit & ~foreign, 0.2, "ticker in text"), ((F.length(name) >= 4) & text.contains(name), 0.15, "name in text"),
        (views >= 1_000_000, 0.4, "1M+ views"), ((views >= 500_000) & (views < 1_000_000), 0.3, "500k+ views"),
        ((views >= min_viral) & (views < 500_000), 0.25, "viral views"), ((views >= 10_000) & (views < min_viral), 0.05, "10k+ views"),
        ((views >= 1_000) & (views < 10_000), -0.1, "low views"), (views < 1_000, -0.25, "negligible views"),
        (post["media"].isNotNull(), 0.05, "has media"), (F.coalesce(post["text"], F.lit("")).rlike("^RT @"), -0.35, "retweet"),
        (post["followers"] >= 500_000, 0.1, "major account"),
    ]
    all_of = lambda given: [text.contains(w) for w in given]
    for story in stories or []:
        told = [F.array_contains(words, w) for w in story.get("name", ())] + all_of(story.get("text", ()))
        if story.get("any"):
            told.append(functools.reduce(operator.or_, all_of(story["any"])))
        if story.get("followers"):
            told.append(F.coalesce(post["followers"] >= story["followers"], F.lit(False)))
        rules.append((functools.reduce(operator.and_, told, F.lit(True)), story["points"], story["reason"]))
    for a in accounts or []:
        by = F.lower(F.coalesce(post["handle"], F.lit(""))) == a["handle"]
        rules.append((functools.reduce(operator.and_, all_of(a.get("text", ())), by), a["points"], a["reason"]))
    said = lambda w: F.exists(F.coalesce(F.try_element_at(known, w), F.array(w)), lambda x: text.contains(x)) if synonyms else text.contains(w)
    known = F.create_map(*[x for k, v in (synonyms or {}).items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if synonyms else None
    score, reasons = F.size(F.filter(words, said)) * 0.12, []
    for rule, points, reason in rules:
        score = score + F.when(rule, points).otherwise(0.0)
        reasons.append(F.when(rule, reason))
    score = F.when(wrong, F.least(score, F.lit(0.2))).otherwise(score)
    score = F.when(~own & (views < min_viral), F.least(score, F.lit(0.34))).otherwise(score)
    return F.struct(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"), wrong.alias("wrong_address"))
