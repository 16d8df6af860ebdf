"""A prefix trie of conversations, one row for each node.

Conversations that are equal turn by turn are one sequence with a weight, so that no number of copies makes a
subtrie large. Sequences are dealt out by a hash of their first turn's digest, and each task's sequences
are put into tries of dictionaries and added up in iterative postorder, inside applyInPandas.

A first-turn subtrie of more rows than a task's share (or than `limit`) isn't built in one task. The turns that all
its sequences share, one or many, become a stretch of nodes, and what follows is dealt out anew by
the next turn, again and again. A stretch is added up by running sums, so that a conversation of any
length goes through no single task; its nodes' totals come from the tops of what hangs below it, round by round from the last.

Turns meet by 120 bits of an MD5 of role and text, sequences by two xors of 64-bit hashes over (place, turn). The
SHA-256 of a node's ends takes one sequence's conversation ids in order. They are put into strings of at most 65536 ids each
by many tasks; a sequence of several such strings goes through one task as a stream, as SHA-256 asks for, which keeps one string at a time.

Defined cases. Turns are ordered by turn (null first), then role and text. A null role or text is empty. Rows without conv_id belong to no
conversation and are left out. An empty table has no node, not even a root. Of one conversation's turns, those in a row of 512
turn numbers are numbered in one task. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.llm.asof import crc, crc_sql
from sparkvane.llm.common import met, read, running, written

#: Rows (turns of distinct sequences) of a subtrie that one task builds at most, whatever its share; some 500 bytes each while it does.
LIMIT = 50_000
#: Turns that a rebuilt conversation can get from another.
MOST = 5
_NUMBERED = 512
#: An id string is of the ids that have the same bits above these.
_CHUNK = 10
#: Rows of a task's share at least, and places of a stretch that are summed together.
_LEAST, _PLACES = 100, 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, end_conv long, top1 long, top2 long"  # tops: the part of a subtrie's key that it hangs below


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (the turn's digest), chars of every turn of a conversation with an id."""
    said = turns.where("conv_id is not null").select("conv_id", "turn", F.floor(F.col("turn") / _NUMBERED).alias("bucket"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text"))
    md5 = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    part = [F.conv(F.substring("md5", at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "d1"), (16, "d2"))]
    rows = written(said.select("conv_id", "bucket", inside.alias("inside"), md5.alias("md5"), F.length("text").cast("long").alias("chars")).select("conv_id", "bucket", "inside", *part, "chars"))
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"))
    # most conversations are in one bucket; only what comes after another needs an offset
    before = before.where("n_before > 0").select(F.col("conv_id").alias("b_conv"), F.col("bucket").alias("b_bucket"), "n_before")
    out = rows.join(before, (F.col("conv_id") == F.col("b_conv")) & (F.col("bucket") == F.col("b_bucket")), "left")
    return out.select("conv_id", (F.col("inside") + F.coalesce("n_before", F.lit(0))).alias("pos"), "d1", "d2", "chars")


def rebuilt(turns: DataFrame, head: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, d1, d2, chars) of all rebuilt conversations, and (conv_id) of those without turns.

    Each conversation's first `head` turns, at most MOST, are those of conversation `source` (columns over conv_id); as many of its own go.
    """
    rows = written(numbered(turns))
    convs = written(rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", head.alias("head"), source.alias("source")))
    sources = convs.select(F.col("source").alias("conv_id")).distinct()
    heads = rows.where(F.col("pos") <= MOST).join(sources, "conv_id", "left_semi").groupBy(F.col("conv_id").alias("source"))
    heads = written(heads.agg(F.collect_list(F.struct("pos", "d1", "d2", "chars")).alias("turns")))
    given = met(convs, heads, ["source"], F.col("conv_id"), "inner").select("conv_id", "head", F.inline("turns")).where("pos <= head").drop("head")
    given = written(given)
    n_given = written(given.groupBy("conv_id").agg(F.count("*").alias("n_given")))
    own = met(rows.withColumn("head", head).where("pos > head"), n_given, ["conv_id"], F.col("pos"))
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.coalesce("n_given", F.lit(0))).alias("pos"), "d1", "d2", "chars")
    silent = convs.where("n <= head").select("conv_id").join(n_given, "conv_id", "left_anti")
    return written(given.unionByName(own)), silent


def sequences(rows: DataFrame, silent: DataFrame) -> DataFrame:
    """conv (least conversation), n (conversations), len, ends_sha256 (of their ids in order) of every distinct sequence."""
    both = [F.bit_xor(h).alias(f"x{i}") for i, h in ((1, F.xxhash64("pos", "d1", "d2")), (2, F.xxhash64("d2", "d1", "pos")))]
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("len"), *both)
    zero = F.lit(0).cast("long")
    whole = whole.unionByName(silent.select("conv_id", zero.alias("len"), zero.alias("x1"), zero.alias("x2")))
    keys = ["len", "x1", "x2"]
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    strings = written(whole.groupBy(*keys, F.shiftright("conv_id", _CHUNK).alias("chunk")).agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), ids))
    found = strings.groupBy(*keys).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.count("*").alias("chunks"), F.max(F.sha2("ids", 256)).alias("sha"))
    found = written(found)
    streamed = strings.select(*keys, "chunk", "ids").join(found.where("chunks > 1").select(*keys), keys, "left_semi")
    streamed = streamed.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInPandas(_streamed_sha, "s_len long, s_x1 long, s_x2 long, streamed string")
    same = [F.col(k) == F.col(f"s_{k}") for k in keys]
    out = found.where("chunks > 1").join(streamed, same).select("conv", "n", "len", F.col("streamed").alias("ends_sha256"))
    return written(found.where("chunks = 1").select("conv", "n", "len", F.col("sha").alias("ends_sha256")).unionByName(out))


def _streamed_sha(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each key's strings joined by commas; rows are sorted by key and chunk."""
    now, sha, done = None, None, []
    for batch in batches:
        for *key, _, ids in batch.itertuples(index=False):
            if key != now:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["s_len", "s_x1", "s_x2", "streamed"])
        done = []
    if now is not None:
        yield pd.DataFrame([(*now, sha.hexdigest())], columns=["s_len", "s_x1", "s_x2", "streamed"])


def built(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of whole subtries; rows are conv, n, len, pos, d1, d2, chars, g1, g2 (the subtrie), top1, top2 (what it hangs below), up (the conversation above)."""
    names = ["g1", "g2", "conv", "pos", "d1", "d2", "chars", "n", "len", "top1", "top2", "up"]
    rows = rows[names].sort_values(["g1", "g2", "conv", "pos"])
    tops: dict[tuple[int, int], int] = {}
    children: list[dict[tuple[int, int], int]] = []
    conv, depth, parent, chars, n, end, top1, top2 = [], [], [], [], [], [], [], []
    seen, at = None, -1
    for g1, g2, c, pos, d1, d2, length, weight, whole, t1, t2, up in rows.itertuples(index=False):
        first, seen = (g1, g2, c) != seen, (g1, g2, c)
        below, key = (tops, (g1, g2)) if first else (children[at], (d1, d2))
        above = at
        if (at := below.get(key, -1)) < 0:
            at = below[key] = len(children)
            children.append({})
            # conversations come in order, so a node's first is its least
            for column, value in ((conv, c), (depth, pos), (parent, up if first else conv[above]), (chars, length), (n, 0), (end, None), (top1, t1 if first else None), (top2, t2 if first else None)):
                column.append(value)
        n[at] += weight
        if pos == whole:
            end[at] = c
    leaves, saved = [0] * len(n), [0] * len(n)
    todo = [(top, False) for top in tops.values()]
    while todo:
        i, ready = todo.pop()
        kids = children[i].values()
        if not ready:
            todo.append((i, True))
            todo.extend((kid, False) for kid in kids)
        else:
            leaves[i] = sum(leaves[kid] for kid in kids) or 1
            saved[i] = (n[i] - 1) * chars[i] + sum(saved[kid] for kid in kids)
    columns = (conv, depth, parent, n, [len(kids) for kids in children], leaves, saved, end, top1, top2)
    return pd.DataFrame({name.split()[0]: pd.array(column, dtype="Int64") for name, column in zip(NODES.split(", "), columns, strict=True)})


KEY = ["g1", "g2"]


def _descended(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows of subtries that are too large: the stretches that all of a subtrie's sequences share (one row each), their turns, and the rows below them."""
    one = (F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))
    ends = F.max(F.when(F.col("pos") == F.col("len"), F.col("conv")))
    stat = rows.groupBy(*KEY, "pos").agg(one.alias("one"), F.max("chars").alias("chars"), F.min("len").alias("least"), F.sum("n").alias("n"), F.min("conv").alias("conv"), ends.alias("ends"), *[F.max(c).alias(c) for c in ("top1", "top2", "up")])
    stat = written(stat)
    last = F.least(F.min(F.when(~F.col("one"), F.col("pos"))) - 1, F.min("least"))
    stretch = stat.groupBy(*KEY).agg(F.min("pos").alias("first"), last.alias("last"), F.max("n").alias("n_convs"), F.min("conv").alias("conv"), *[F.max(c).alias(c) for c in ("top1", "top2", "up")])
    stretch = written(stretch)
    turns = written(met(stat.select(*KEY, "pos", "chars", "ends"), stretch.select(*KEY, "last"), KEY, F.col("pos"), "inner").where("pos <= last"))
    salt = F.xxhash64("conv", "pos")
    kept = stretch.select(*KEY, "last", F.col("conv").alias("up"))
    rest = met(rows.drop("top1", "top2", "up"), kept, KEY, salt, "inner").where("pos > last").withColumnsRenamed({"g1": "top1", "g2": "top2"})
    rest = written(rest)
    turn = ["top1", "top2", "d1", "d2"]
    heads = written(rest.where("pos = last + 1").select("conv", F.xxhash64(*turn).alias("g1"), F.xxhash64(*turn[::-1]).alias("g2")))
    return stretch, turns, met(rest.drop("last"), heads, ["conv"], F.col("pos"), "inner")


def _added_up(stretch: DataFrame, turns: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of stretches, from the last turn, which has the tops below it as children, to the first."""
    kids = tops.groupBy(F.col("top1").alias("k1"), F.col("top2").alias("k2")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
    whole = turns.groupBy(F.col("g1").alias("w1"), F.col("g2").alias("w2")).agg(F.sum("chars").alias("whole"))
    known = stretch.drop("last").join(kids, (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2")), "left").join(whole, (F.col("g1") == F.col("w1")) & (F.col("g2") == F.col("w2")))
    known = written(known.drop("k1", "k2", "w1", "w2").na.fill({"kids": 0, "leaves": 1, "below": 0}))
    upto = running(turns.withColumn("bucket", F.floor(F.col("pos") / _PLACES)), KEY, "bucket", ["pos"], "chars", "upto").drop("bucket")
    lines = met(upto, known, KEY, F.col("pos"), "inner")
    first, end = F.col("pos") == F.col("first"), F.col("pos") == F.col("last")
    return lines.select(
        "conv", F.col("pos").alias("depth"), F.when(first, F.col("up")).otherwise(F.col("conv")).alias("parent"), "n_convs", F.when(end, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("whole") - F.col("upto") + F.col("chars"))).alias("saved"), F.when(end, F.col("ends")).alias("end_conv"),
        *[F.when(first, F.col(c)).alias(c) for c in ("top1", "top2")],
    )


def trie(rows: DataFrame, found: DataFrame, limit: int = LIMIT, least: int = _LEAST) -> DataFrame:
    """The nodes of the trie of `found` (conv, n, len), whose turns are among rows (conv_id, pos, d1, d2, chars)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(0).cast("long")
    root = written(found.agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("conv"))).alias("end_conv")).where("conv is not null"))
    turns = met(rows.withColumnRenamed("conv_id", "conv"), written(found.where("len > 0").select("conv", "n", "len")), ["conv"], F.col("pos"), "inner")
    heads = written(turns.where("pos = 1").select("conv", F.col("d1").alias("g1"), F.col("d2").alias("g2")))
    live = met(turns, heads, ["conv"], F.col("pos"), "inner").crossJoin(F.broadcast(root.select(F.col("conv").alias("up")))).withColumns({"top1": zero, "top2": zero})
    rounds, share = [], None
    while True:
        live = written(live)
        sizes = written(live.groupBy(*KEY).agg(F.count("*").alias("size")))
        total = sizes.agg(F.sum("size")).head()[0] or 0
        share = share or min(limit, max(least, 2 * total // parts))
        large = written(sizes.where(F.col("size") > share).withColumn("large", F.lit(True)).drop("size"))
        told = met(live, large, KEY, F.xxhash64("conv", "pos"))
        dealt = told.where("large is null").drop("large").withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(max(parts, -(-total // share)))))
        nodes = written(dealt.groupBy("task").applyInPandas(lambda task: built(task), NODES))
        if large.isEmpty():
            rounds.append((nodes, None, None))
            break
        stretch, shared, live = _descended(told.where("large").drop("large"))
        rounds.append((nodes, stretch, shared))
    out = tops = None
    for nodes, stretch, shared in reversed(rounds):
        if stretch is not None:
            nodes = nodes.unionByName(written(_added_up(stretch, shared, tops)))
        tops = nodes.where("top1 is not null")
        out = nodes if out is None else out.unionByName(nodes)
    sums = tops.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    top = root.crossJoin(F.broadcast(sums)).withColumns({"depth": zero, "parent": F.lit(None).cast("long"), "top1": zero, "top2": zero})
    return out.unionByName(top).drop("top1", "top2")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all `conversations`, each rebuilt on the first turns of conversation conv_id - conv_id % 100; null roles and texts are empty, rows without conv_id are left out, an empty table has no nodes."""
    rows, silent = rebuilt(read(spark, sf_dir, "conversations"), crc(F.col("conv_id")) % 6, F.col("conv_id") - F.col("conv_id") % 100)
    found = sequences(rows, silent)
    nodes = written(trie(rows, found))
    ended = nodes.where("end_conv is not null").join(found.select(F.col("conv").alias("end_conv"), "ends_sha256"), "end_conv")
    out = nodes.where("end_conv is null").withColumn("ends_sha256", F.lit(_EMPTY)).unionByName(ended)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


#: A node is the text of its turns' hashes, put together; what is below it begins with that.
OP13_SQL = f"""
with turn as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
conv as (
  select conv_id, {crc_sql("conv_id")} % 6 as head, conv_id - conv_id % 100 as source from (select distinct conv_id from turn)),
again as (
  select c.conv_id, 0 as part, pos, digest, chars from conv c join turn t on t.conv_id = c.source where pos <= head
  union all select c.conv_id, 1, pos, digest, chars from conv c join turn t on t.conv_id = c.conv_id where pos > head),
prefix as (
  select conv_id, row_number() over w as depth, chars, string_agg(digest, '') over w as node from again
  window w as (partition by conv_id order by part, pos rows between unbounded preceding and current row)
  union all select conv_id, 0, 0, '' from conv),
length_ as (select conv_id, max(depth) as len from prefix group by conv_id),
node as (
  select node, depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where depth = len), '')) as ends
  from prefix p join length_ l on p.conv_id = l.conv_id group by node, depth),
child as (
  select p.node, count(*) as n from node p join node c on c.depth = p.depth + 1 and starts_with(c.node, p.node) group by p.node),
kin as (
  select n.*, coalesce(child.n, 0) as n_children from node n left join child on child.node = n.node)
select a.conv_id, a.depth, max(p.conv_id) as parent_conv_id, a.n_convs, a.n_children,
  cast(sum(case when b.n_children = 0 then 1 else 0 end) as bigint) as n_leaves, cast(sum((b.n_convs - 1) * b.chars) as bigint) as saved_tokens, a.ends as ends_sha256
from kin a join kin b on b.depth >= a.depth and starts_with(b.node, a.node)
left join kin p on p.depth = a.depth - 1 and starts_with(a.node, p.node)
group by a.node, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends
"""
