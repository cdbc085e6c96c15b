"""Tables of the data model and their columns; unknown names raise at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and types of the tables' columns.
TABLES = {
    "narrative_posts": "id string, narrative_id string, platform string, platform_post_id string, sort_order int, handle string, text string, followers int, image boolean, media_url string, media_type string, views long, replies long, quotes long, likes long, retweets long, notable boolean, sample_replies array<string>, posted_at long, posted_at_ts timestamp, first_seen_at timestamp, last_snapshot_at timestamp, tracking_status string, pruned_at timestamp, snapshot_tier string, filter_label string, raw string, cluster_match string, subject_entity string, ct_pickup boolean, ticker_proposal_count int, sound_id string",
    "post_snapshots": "id string, post_id string, captured_at timestamp, views long, likes long, replies long, retweets long, quotes long, bookmarks long, unavailable boolean, raw string",
    "post_meme_scores": "post_id string, meme_score double, suggested_ticker string, suggested_name string, model string, reason string, raw string, scored_at timestamp, velocity double, views_velocity double, engagement_velocity double",
    "post_embeddings": "post_id string, embedding map<string,double>, updated_at timestamp",
    "narratives": "id string, title string, blurb string, img_seed int, created_at long, narr_idx int, search_series array<double>, lead_time_min int, organic_score int, source string, status string, display_eligible boolean, gate_reason string, combined_views long, views_velocity double, author_velocity double, distinct_authors int, gain_24h long, accel double, engagement_velocity double, lifecycle string, age_min int, meme_score double, max_meme_score double, platforms array<string>, cross_platform boolean, ct_pickup boolean, bought_reach boolean, ticker_proposals int, top_post_id string, trend_term string, trend_peak double, trend_direction string, first_seen_at timestamp, updated_at timestamp",
    "narrative_tickers": "id string, narrative_id string, ticker string, name string, mcap double, liquidity double, vol24h double, holders int, age_min int, first_deployed boolean, endorsed_by string, canonical boolean, safety string, smart_money string, mint_ca string, dex_url string, pump_url string, lookup_at timestamp",
    "ingest_near_miss": "platform_post_id string, platform string, views long, likes long, first_seen_at timestamp, last_checked_at timestamp, raw string",
    "worker_usage": "source string, utc_date date, reads_today long, cost_usd double, cost_breakdown map<string,double>, posts_ingested int, updated_at timestamp",
    "worker_budget_state": "id int, utc_date date, reads_today long, hourly_tweets long, hourly_window_start timestamp, adaptive_floor int, floor_catch_all int, floor_media int, floor_slow_burn int, floor_min int, floor_min_decay_at timestamp, media_lane_pct double, ingest_underutilised_since timestamp, updated_at timestamp",
    "worker_cycle_log": "id string, worker string, ran_at timestamp, ingested int, snapshots_written int, pruned int, reads_consumed int, skipped_floor int, adaptive_floor int, budget_note string",
    "worker_trend_cache": "term string, result string, fetched_at timestamp",
    "backtest_runs": "id string, stage string, status string, config string, stats string, started_at timestamp, finished_at timestamp",
    "backtest_tokens": "id string, run_id string, mint string, ticker string, name string, launch_at timestamp, peak_mcap double, peak_multiple double, current_mcap double, peak_liquidity double, holders int, liquidity_exists boolean, liquidity_dead_within_24h boolean, outcome string, narrative_cohort string, source string, raw string, created_at timestamp",
    "backtest_candidates": "id string, run_id string, token_id string, outcome string, status string, narrative_cohort string, name_pass boolean, name_reject_reason string, post_search_queries string, match_confidence double, match_reason string, matched_platform_post_id string, matched_post_text string, matched_post_at timestamp, matched_post_url string, matched_post_raw string, x_queries_run int, x_tweets_read int, created_at timestamp",
    "backtest_post_features": "id string, run_id string, candidate_id string, outcome string, feature_window_min int, views_at_t double, view_velocity_t double, acceleration_t double, author_followers double, engagement_rate_t double, had_media boolean, distinct_authors_t int, age_min_when_seen double, ticker_proposed_in_replies boolean, meme_score double, in_narrative_posts boolean, narrative_post_id string, raw string, created_at timestamp",
    "backtest_spend_log": "id string, run_id string, stage string, tweets_read int, cost_usd double, note string, logged_at timestamp",
}


def columns(table: str) -> list[str]:
    if table not in TABLES:
        raise KeyError(f"unknown table: {table}")
    return [c.split(" ")[0] for c in TABLES[table].split(", ")]


def checked(table: str, *names: str) -> list[str]:
    """The names, or an error for the first that the table lacks."""
    known = columns(table)
    for n in names:
        if n not in known:
            raise KeyError(f"unknown column: {table}.{n}")
    return list(names)


def read(spark: SparkSession, path: str, table: str, *names: str) -> DataFrame:
    """Columns of a table's Parquet files under its declared schema."""
    return spark.read.schema(TABLES[table]).parquet(f"{path}/{table}").select(*(checked(table, *names) if names else columns(table)))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
