"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Every source's documents are put in a seeded shuffled order. A document's virtual finish time is
the number of its source's words up to and with it, divided by the source's target; a source that
must give more than it holds runs through its documents again, up to max_epochs times. The copies
of all sources, sorted by virtual finish time, are taken until the budget, the sum of all
sizes, is used up.

Defined cases. A null text counts no words; a document without words takes 0 words. The null
source is a source of its own and the last one. Rows that agree in doc_id, source, size and text
are one item of their joint size, so that repeated rows get the same decision. An empty
table gives an empty result. Other columns, whatever their names, are not looked at. The one slot of
virtual time in which the budget ends is taken in order by one task: 1 of SLOTS / 2 parts of the copies that
are due before time 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.llm.common import fresh, read, running, word_count, written

#: Parts of the shuffled order of a source, and of the virtual time between 0 and 2.
PARTS, SLOTS = 4096, 4096


def targets(items: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: __source, rank, source_size, target.

    A target is min(max_epochs * size, level * weight), with the one level at which the targets add
    up to all sizes: what resharing the excess by weight comes to. The windows are over one row a
    source (some 50 bytes): sources must be few enough for one task to sort, millions at most.
    """
    sources = items.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    sources = sources.withColumn("rank", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs)
    first = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    everything = Window.partitionBy()
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # the first source, in order of cap / weight, that is not held by its cap sets the level
    free = F.col("cap") * F.col("left_weight") >= F.col("left") * F.col("weight")
    level = lambda c: F.min_by(c, F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everything)
    sources = sources.withColumns({"l": level("left"), "lw": level("left_weight")})
    share = F.col("l") * F.col("weight") / F.col("lw")
    held = F.col("cap") * F.col("lw") < F.col("l") * F.col("weight")
    return sources.select(F.col("source").alias("__source"), "rank", "source_size", F.when(held, F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Per item (doc_id, source, size, text_hash): rows, source_size, target, copies.

    copies is the number of times that each of the item's rows goes into the mix.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    slim = slim.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = written(slim.withColumns({"words": F.col("size") * F.col("rows"), "key": key}))

    items = slim.join(targets(slim, weights, max_epochs), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    items = items.withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))  # PARTS parts
    order = ["key", "doc_id", "size", "text_hash"]
    items = written(running(items, ["source"], "part", order, "words", "served"))

    time = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("served")) / F.col("target")).otherwise(F.lit(0.0))
    copies = items.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("time", time)
    copies = copies.withColumn("slot", F.least(F.floor(F.col("time") * (SLOTS // 2)), F.lit(SLOTS)).cast("int"))
    sums = copies.groupBy("slot").agg(F.sum("words").alias("in_slot"))
    up_to = F.sum("in_slot").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("up_to", up_to).withColumn("before", F.col("up_to") - F.col("in_slot"))  # SLOTS + 1 rows
    budget = slim.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("budget"))
    marks = sums.crossJoin(F.broadcast(budget)).select("slot", "before", "up_to", "budget")
    copies = copies.join(F.broadcast(marks), "slot")
    whole = copies.where(F.col("up_to") <= F.col("budget"))
    # one slot is cut: its copies are taken in order while they fit
    cut = copies.where((F.col("up_to") > F.col("budget")) & (F.col("before") < F.col("budget")))
    inside = F.sum("words").over(Window.partitionBy("slot").orderBy("time", "rank", *order, "epoch").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("inside", inside).where(F.col("before") + F.col("inside") <= F.col("budget")).drop("inside")
    given = whole.unionByName(cut).groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies"))
    given = given.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "text_hash")], "copies")
    same = [items[c].eqNullSafe(given[f"__{c}"]) for c in ("doc_id", "source", "size", "text_hash")]
    return items.join(given, same, "left").select("doc_id", "source", "size", "text_hash", "rows", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and source and copies, of every document."""
    out = mix(read(spark, sf_dir, "documents"))
    out = out.withColumn(fresh(out, "row"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


OP4_SQL = r"""
with item as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
src as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) - 1 as rank
  from item group by source),
weighed as (select *, [5, 2, 1][rank % 3 + 1] as weight, source_size * 3 as cap from src),
level as (
  select *,
    sum(source_size) over () - coalesce(sum(cap) over w, 0) as left_size,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as left_weight
  from weighed
  window w as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
picked as (
  select left_size as l, left_weight as lw from level
  where cap * left_weight >= left_size * weight order by cap / weight, rank limit 1),
target as (
  select source, rank, source_size,
    case when cap * lw < l * weight then cast(cap as double) else cast(l * weight as double) / cast(lw as double) end as target
  from weighed, picked),
served as (
  select item.*, rank, source_size, target,
    sum(size) over (partition by item.source order by key, doc_id, size rows unbounded preceding) as served
  from item join target on item.source is not distinct from target.source),
copies as (
  select *, case when target > 0 then cast(epoch * source_size + served as double) / target else 0 end as t
  from served, (select unnest([0, 1, 2]) as epoch)),
queue as (
  select *, sum(size) over (order by t, rank, key, doc_id, size, epoch rows unbounded preceding) as used from copies),
given as (
  select doc_id, source, size, count(*) as copies from queue
  where used <= (select sum(size) from item) group by all)
select s.doc_id, s.source, s.size, cast(s.source_size as bigint) as source_size, s.target,
  cast(s.size * coalesce(g.copies, 0) as bigint) as taken, cast(coalesce(g.copies, 0) as bigint) as copies
from served s left join given g on s.doc_id is not distinct from g.doc_id and s.source is not distinct from g.source and s.size = g.size
"""
