"""The engine's tables made from the test tables, and the same in DuckDB's SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.sources.tables import TRACKS, conformed, spread

PERSONA, RULES_TEXT = " You are a guide to a shop of records. ", "Name a track.\nSay why it fits.\n"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    one = lambda c: F.array(c)
    return p.select(
        F.col("p_partkey").cast("string").alias("track_id"), one("p_name").alias("track_name"), one("p_brand").alias("artist_name"), one("p_type").alias("album_name"),
        one(F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-01-01"))).alias("release_date"), F.split("p_name", " ").alias("tag_list"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("age_group"), F.lit(None).cast("string").alias("gender"), F.col("n_name").alias("country_name"))


def music_of(c):
    return (c * 37 % 2500).cast("string")


def user_of(c):
    return (c * 11 % 2000).cast("string")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, pos, turn_number, role, content: system rows left out, a music turn after each first user message."""
    c = read(spark, sf_dir, "conversations").where("role <> 'system'")
    up_to = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("users", F.sum((F.col("role") == "user").cast("int")).over(up_to))
    own = c.select(F.col("conv_id").alias("s"), (F.col("turn") * 2).cast("int").alias("pos"), F.greatest("users", F.lit(1)).cast("int").alias("turn_number"), "role", F.col("text").alias("content"))
    music = c.where("role = 'user' and users = 1").select(F.col("conv_id").alias("s"), (F.col("turn") * 2 + 1).cast("int").alias("pos"), F.lit(1).alias("turn_number"), F.lit("music").alias("role"), music_of(F.col("conv_id")).alias("content"))
    return own.unionByName(music)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("pos", "turn_number", "role", "content")))
    held = messages(spark, sf_dir).groupBy("s").agg(F.transform(turns, lambda t: F.struct(t["turn_number"].alias("turn_number"), t["role"].alias("role"), t["content"].alias("content"))).alias("conversations"))
    goal = F.when(F.col("s") % 3 == 0, F.concat(F.lit("mood "), F.col("s").cast("string")))
    return held.select(F.col("s").cast("string").alias("session_id"), user_of(F.col("s")).alias("user_id"), F.lit(None).cast("string").alias("user_profile"), goal.alias("conversation_goal"), "conversations")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns with documents as responses, and some of each kind that is rejected first."""
    d = F.col("doc_id")
    return spread(read(spark, sf_dir, "documents")).select(
        d.cast("string").alias("session_id"), user_of(d).alias("user_id"), F.lit("").alias("user_profile"), F.when(d % 3 == 0, F.concat(F.lit("mood "), d.cast("string"))).alias("conversation_goal"),
        F.when(d % 17 != 0, F.concat(F.lit("play "), d.cast("string"))).alias("user_query"), F.when(d % 31 != 0, music_of(d)).alias("music_id"),
        F.when(d % 19 == 0, F.lit(None)).when(d % 23 == 0, F.lit("")).when(d % 29 == 0, F.lit(" Unknown Message ")).otherwise(F.col("text")).alias("assistant_raw"),
    )


#: Openers, claims and ends that the default lexicon judges in every way.
OPENERS = ["Great choice!", "That’s wonderful.", "I'm so glad to hear it.", "Right on!", "Here's another.", "Let’s keep going.", "", "Since you enjoyed that, more.", "You nailed it!", "Oké then.", "Right away!", "It was a glad day.", "Awesome! Cool. Yes!"]
CLAIMS = ["", "This is truly good.", "I’m so sorry about it.", "Unfortunately none.", "No luck with it.", "I couldn't find it.", "Happy you enjoyed it.", "You’re loving this one.", "untruly said", "I cannot seek", "fantastical"]
ENDS = ["*Song* (1994).", "“Quiet” ends", '"ab"', "(94).", "*x*)", "end,", 'It is "a"!']


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triples with an opener, a claim and an end around each response."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("session_id").cast("int") % len(words) + 1).cast("int"))
    raw = F.col("assistant_raw")
    full = F.concat_ws(" ", pick(OPENERS), raw, pick(CLAIMS), pick(ENDS))
    return triples(spark, sf_dir).withColumn("assistant_raw", F.when(raw.isin("", " Unknown Message ") | raw.isNull(), raw).otherwise(full))


def scalar_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as a source with plain values in place of lists has it, read into the engine's schema."""
    p = read(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    plain = p.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist_name"), F.when(odd, F.col("p_type")).alias("album_name"), (F.col("p_size") + 1990).cast("string").alias("release_date"), F.when(odd, F.col("p_type")).alias("tag_list"))
    return conformed(plain, TRACKS)


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id and a dict of each kind of value."""
    n, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(n % 4 == 0, name).when(n % 4 == 1, F.concat(F.lit("it's "), name)).when(n % 4 == 2, F.concat(F.lit('say "'), name, F.lit('"'))).otherwise(F.concat(F.lit("it's \"x\" "), name, F.lit("\nend\\")))
    goal = F.struct(said.alias("listener_goal"), F.when(n % 5 != 0, F.col("p_size")).alias("turns"), F.array("p_brand", F.when(n % 3 == 0, F.col("p_type"))).alias("tags"), (n % 2 == 0).alias("done"))
    return read(spark, sf_dir, "part").select(n.cast("string").alias("track_id"), goal.alias("goal"))


def short_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


# --- the same in DuckDB ---------------------------------------------------------------------------

TRACKS_SQL = """tracks as (select cast(p_partkey as varchar) as track_id, p_name as name, p_brand as artist, p_type as album,
  cast(p_size + 1990 as varchar) || '-01-01' as release, string_split(p_name, ' ') as tags from part)"""
LINE = """'"' || name || '"' || ' by ' || artist || ' (' || album || ', ' || split_part(release, '-', 1) || ')' || ' [tags: ' || array_to_string(tags[1:5], ', ') || ']'"""
META = """'track_id: ' || track_id || ', track_name: ' || lower(name) || ', artist_name: ' || lower(artist) || ', album_name: ' || lower(album) || ', release_date: ' || lower(release)"""
PROFILE = """'user_id: ' || c_custkey || chr(10) || 'age_group: ' || coalesce(c_mktsegment, 'None') || chr(10) || 'gender: None' || chr(10) || 'country_name: ' || coalesce(n_name, 'None')"""
USERS_SQL = f"users as (select cast(c_custkey as varchar) as user_id, {PROFILE} as profile from customer join nation on c_nationkey = n_nationkey)"
MESSAGES_SQL = """counted as (
  select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as users
  from conversations where role <> 'system'),
messages as (
  select conv_id as s, turn * 2 as pos, greatest(users, 1) as turn_number, role, text as content from counted
  union all
  select conv_id, turn * 2 + 1, 1, 'music', cast(conv_id * 37 % 2500 as varchar) from counted where role = 'user' and users = 1)"""
TRIPLES_SQL = """triples as (
  select cast(doc_id as varchar) as session_id, cast(doc_id * 11 % 2000 as varchar) as user_id,
    case when doc_id % 3 = 0 then 'mood ' || doc_id end as goal,
    case when doc_id % 17 <> 0 then 'play ' || doc_id end as user_query,
    case when doc_id % 31 <> 0 then cast(doc_id * 37 % 2500 as varchar) end as music_id,
    case when doc_id % 19 = 0 then null when doc_id % 23 = 0 then '' when doc_id % 29 = 0 then ' Unknown Message ' else text end as assistant_raw
  from documents)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


PHRASED_SQL = f"""phrased as (
  select * replace (case when coalesce(assistant_raw, '') in ('', ' Unknown Message ') then assistant_raw
    else concat_ws(' ', {_list(OPENERS)}[cast(session_id as int) % {len(OPENERS)} + 1], assistant_raw, {_list(CLAIMS)}[cast(session_id as int) % {len(CLAIMS)} + 1], {_list(ENDS)}[cast(session_id as int) % {len(ENDS)} + 1]) end as assistant_raw)
  from triples)"""
GOALS_SQL = r"""select cast(p_partkey as varchar) as track_id,
  '{''listener_goal'': ' || case p_partkey % 4 when 0 then '''' || p_name || '''' when 1 then '"it''s ' || p_name || '"' when 2 then '''say "' || p_name || '"''' else '''it\''s "x" ' || p_name || '\nend\\''' end
  || ', ''turns'': ' || case when p_partkey % 5 <> 0 then cast(p_size as varchar) else 'None' end
  || ', ''tags'': [''' || p_brand || ''', ' || case when p_partkey % 3 = 0 then '''' || p_type || '''' else 'None' end || ']'
  || ', ''done'': ' || case when p_partkey % 2 = 0 then 'True' else 'False' end || '}' as goal
from part"""
