"""Chat formatting by multi-party perspective rotation. SQL functions only.

Every participant of a dialogue, whoever is not `system`, in turn becomes the assistant: the
dialogue is rendered once for each, with the others as named users, and a mask, spans of
characters [start, end), covers just what that participant says, with the closing newline.

Defined cases. A null text is empty and a null role is the participant `unknown`. Messages are ordered by
turn (null first), role and text, so ties and repeated rows have one order. A row holds max_turns
messages at most, counted by place and not by turn number, so that no rendering need fit in one row:
a longer dialogue's rendering comes in consecutive pieces for every participant of the dialogue, silent
in a piece or not. Its pieces' texts, put together, are the whole rendering, and the spans of the
masks count from the dialogue's beginning. Where only `system` speaks nothing can be learned and no
row results. A message without conv_id is a dialogue of its own, whatever others have none. No table rows, no result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import read, running

MAX_TURNS = 512

#: Of messages with their place among those of the dialogue.
WHOLE = r"""
with placed as (select conv_id, cast(floor((pos - 1) / @max_turns@) as bigint) as piece, role, text, pos from @placed@),
speakers as (select distinct conv_id, role as speaker from placed where role <> 'system'),
pieces as (
  select conv_id, piece, sum(length(case when role = 'system' then '<|system|>' else concat('<|user ', role, '|>') end) + length(text) + 1) as size
  from placed group by conv_id, piece),
own as (
  select conv_id, piece, role, sum(length('<|assistant|>') - length(concat('<|user ', role, '|>'))) as more
  from placed where role <> 'system' group by conv_id, piece, role),
begins as (
  select p.conv_id, p.piece, speaker,
    coalesce(sum(size + coalesce(more, 0)) over (partition by p.conv_id, speaker order by p.piece rows between unbounded preceding and 1 preceding), 0) as begin
  from pieces p join speakers s on p.conv_id is not distinct from s.conv_id
  left join own o on p.conv_id is not distinct from o.conv_id and p.piece = o.piece and speaker = o.role),
lines as (
  select p.conv_id, p.piece, speaker, begin, pos, role, text,
    case when role = 'system' then '<|system|>' when role = speaker then '<|assistant|>' else concat('<|user ', role, '|>') end as head
  from placed p join begins b on p.conv_id is not distinct from b.conv_id and p.piece = b.piece),
spans as (
  select conv_id, piece, speaker, pos, role, concat(head, text, '
') as line,
    begin + sum(length(head) + length(text) + 1) over (partition by conv_id, piece, speaker order by pos rows between unbounded preceding and current row) as stop,
    length(text) + 1 as said_length
  from lines)
select conv_id, piece, speaker as assistant,
  cast(count(*) as bigint) as n_messages,
  cast(sum(case when role = speaker then said_length else 0 end) as bigint) as n_masked,
  array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '') as text,
  array_join(transform(array_sort(collect_list(case when role = speaker then struct(pos, concat(cast(stop - said_length as string), '-', cast(stop as string)) as span) end)), x -> x.span), ',') as mask
from spans group by conv_id, piece, speaker
"""


def rotate(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id, piece, assistant, n_messages, n_masked, text, mask: a row for each participant of each dialogue and each piece of it."""
    known = conversations.where("conv_id is not null")
    said = known.select(
        "conv_id", "turn", F.floor(F.col("turn") / max_turns).alias("bucket"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"),
    )
    name = f"placed_{id(conversations)}"
    running(said, ["conv_id"], "bucket", ["turn", "role", "text"], "one", "pos").createOrReplaceTempView(name)  # a plan is bound to the view at once
    out = conversations.sparkSession.sql(WHOLE.replace("@max_turns@", str(max_turns)).replace("@placed@", name))
    conversations.sparkSession.catalog.dropTempView(name)
    role, text, head = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")), "<|assistant|>"
    stop = F.length(text) + len(head) + 1
    alone = conversations.where("conv_id is null").where(role != "system").select(
        "conv_id", F.lit(0).cast("long").alias("piece"), role.alias("assistant"), F.lit(1).cast("long").alias("n_messages"), (F.length(text) + 1).cast("long").alias("n_masked"),
        F.concat(F.lit(head), text, F.lit("\n")).alias("text"), F.concat_ws("-", F.lit(str(len(head))), stop.cast("string")).alias("mask"),
    )
    return out.unionByName(alone)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue of `conversations` from each participant's side; null texts are empty, null roles `unknown`, a message without conv_id stands alone, an empty table gives no rows."""
    return rotate(read(spark, sf_dir, "conversations"))


#: Written for itself: offsets run over the whole dialogue before it is cut into rows.
OP2_SQL = r"""
with message as (
  select conv_id, coalesce(role, 'unknown') as who, coalesce(text, '') as body,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as nth
  from conversations where conv_id is not null),
part as (
  select distinct m.conv_id, s.who as me, m.nth, m.who, m.body
  from message m, message s where m.conv_id is not distinct from s.conv_id and s.who <> 'system'),
spoken as (
  select *, case who when 'system' then '<|system|>' when me then '<|assistant|>' else '<|user ' || who || '|>' end || body || chr(10) as line from part),
ends as (
  select *, cast(sum(length(line)) over (partition by conv_id, me order by nth) as bigint) as stop from spoken)
select conv_id, nth // @max_turns@ as piece, me as assistant, count(*) as n_messages,
  cast(coalesce(sum(length(body) + 1) filter (where who = me), 0) as bigint) as n_masked,
  string_agg(line, '' order by nth) as text,
  coalesce(string_agg((stop - length(body) - 1) || '-' || stop, ',' order by nth) filter (where who = me), '') as mask
from ends group by conv_id, nth // @max_turns@, me
union all
select conv_id, 0, who, 1, length(body) + 1, '<|assistant|>' || body || chr(10), '13-' || (length(body) + 14)
from (select conv_id, coalesce(role, 'unknown') as who, coalesce(text, '') as body from conversations where conv_id is null) where who <> 'system'
""".replace("@max_turns@", str(MAX_TURNS))
