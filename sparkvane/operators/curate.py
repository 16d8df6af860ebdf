"""Curation: first turn of a session, clean-up, ordered funnel with counters, rows for fine-tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.rules import REASONS, CurationRules, reason, strip_warm_opener
from sparkvane.functions.text import profile_text, system_prompt, track_line
from sparkvane.operators.dimension import join_dimension


def first_of(role: str, turn: int = 1) -> Column:
    """Content of the first message of a role in a turn, or null."""
    return F.get(F.filter("conversations", lambda t: (t.turn_number == turn) & (t.role == role)), F.lit(0))["content"]


def first_turn(sessions: DataFrame) -> DataFrame:
    """sessions and user_query, music_id, assistant_raw of turn 1. No explode, no shuffle."""
    return sessions.withColumns({"user_query": first_of("user"), "music_id": first_of("music"), "assistant_raw": first_of("assistant")})


def last_turn(sessions: DataFrame) -> DataFrame:
    """The last message, whatever its role, as the query; is_user tells if it is a user's."""
    last = F.element_at("conversations", -1)
    return sessions.select("session_id", last["content"].alias("query"), last["turn_number"].alias("turn_number"), (last["role"] == "user").alias("is_user"))


def judged(triples: DataFrame, tracks: DataFrame, rules: CurationRules) -> DataFrame:
    """triples (user_query, music_id, assistant_raw, ...) with cleaned and reason, and the track's columns.

    Either comes from a generator of one row, so that a later filter on the reason can't pull copies of
    the patterns below it: each is evaluated once for a row.
    """
    catalog = tracks.withColumn("__known", F.lit(True))
    out = join_dimension(triples, catalog, "music_id", "track_id")
    out = out.select("*", F.explode(F.array(strip_warm_opener(F.col("assistant_raw"), rules))).alias("cleaned"))
    found = reason(F.col("user_query"), F.col("music_id"), F.col("assistant_raw"), F.col("__known").isNotNull(), F.col("cleaned"), rules)
    return out.select("*", F.explode(F.array(found)).alias("reason")).drop("__known")


def funnel_counters() -> dict[str, Column]:
    """Aggregates over judged rows: total_sessions, every reason's count, zeros too, and kept."""
    count = lambda k: F.coalesce(F.sum(F.when(F.col("reason") == k, 1).otherwise(0)), F.lit(0)).cast("long")
    return {"total_sessions": F.count(F.lit(1))} | {k: count(k) for k in [*REASONS, "kept"]}


def funnel_stats(rows: DataFrame) -> DataFrame:
    """One row of the counters, from a pass of its own; a writing job can take them along (`write_observed`)."""
    return rows.agg(*[c.alias(k) for k, c in funnel_counters().items()])


def sft_rows(rows: DataFrame, users: DataFrame, persona: str, rules_text: str) -> DataFrame:
    """session_id, user_query, music_id, system_prompt, assistant_response of kept rows."""
    used = ["session_id", "user_id", "user_profile", "conversation_goal", "user_query", "music_id", "track_name", "artist_name", "album_name", "release_date", "tag_list", "cleaned"]
    # a read of judged rows judges them again
    kept = join_dimension(rows.where("reason = 'kept'").select(*used), users.withColumnRenamed("user_id", "__user").withColumn("__found", F.lit(True)), "user_id", "__user", costly=True)
    profile = F.when(F.col("__found"), profile_text(F.col("user_id"), F.col("age_group"), F.col("gender"), F.col("country_name")))
    line = track_line(F.col("track_name"), F.col("artist_name"), F.col("album_name"), F.col("release_date"), F.col("tag_list"))
    prompt = system_prompt(persona, rules_text, profile, F.col("user_profile"), F.col("conversation_goal"), F.array(line))
    return kept.select(F.concat("session_id", F.lit("_t1")).alias("session_id"), "user_query", "music_id", prompt.alias("system_prompt"), F.col("cleaned").alias("assistant_response"))
