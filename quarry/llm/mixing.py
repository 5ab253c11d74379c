"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow whose documents queue in shuffled order, `most` times over, in packets of at most `PACKET` words.
A packet's virtual finish time is the words of its source up to its end, divided by the source's target. All packets are
range-sorted by virtual finish time; the words are summed up in that order, and the order is truncated at the total
budget, inside a packet if need be. What stands before the cut is the mix.

A hot source is dealt by hash into buckets that one task can sort, prefix sums go over the buckets first and then inside
each. Rows equal in id, source and text are one entry with a number until they are queued. Targets come from a few
aggregations over a table of a row per source; no window sees all sources or all documents.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last in order; equal
rows are separate documents; the order in a source is that of md5 of id and md5 of text, so rows that share an id or have
none are told apart by their texts; an empty table gives an empty result; other columns of the input, whatever their
names, are ignored by mix() and kept by take().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, n_words, ranked, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words that the queue serves at once; a source's share is met to that many words.
PACKET = 256
#: Rows of one source that a window task sorts; a source is dealt over as many buckets as it needs.
BUCKET_ROWS = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, sid, source_size, target of sizes (source, size): the level that all sources fill up to in proportion to
    their weights rises until no further source is above its cap."""
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    per = saved(per.select("source", (F.col("_rank") + 1).alias("sid"), "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    budget = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, spent, number = 0.0, 0.0, -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        seen = per.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count(F.when(capped, 1))).first()
        if seen[2] == number:
            break
        spent, rest, number = seen
        level = (budget - spent) / rest if rest else level
    free = F.lit(budget - spent) / F.lit(rest or 1.0) * F.col("weight")
    return per.select("source", "sid", "source_size", F.when(capped, F.col("cap")).otherwise(free).alias("target"))


def queue(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, text_key, source, sid, size, source_size, target, before (words of the source ahead of it); a row per document."""
    text_key = F.md5(F.col("text").cast("binary"))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_key.alias("text_key"))
    rows = kept(rows.groupBy("doc_id", "source", "size", "text_key").agg(F.count("*").alias("copies")))
    per = targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, most)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("text_key", F.lit(""))).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32))
    parts = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("part")).alias("p").join(per.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "sid", "source_size", "target")
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts.select("source", "bucket", "sid", "source_size", "target", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base")))
    rows = rows.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))).select("d.*", "sid", "source_size", "target", "base")
    inside = Window.partitionBy("sid", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return kept(rows.select("doc_id", "text_key", "source", "sid", "size", "source_size", "target", (F.col("before") + F.col("copy") * F.col("size")).alias("before")))


def _packet(slot: Column) -> tuple[Column, Column, Column]:
    """Turn, end (words of the source up to the packet's end) and words of a document's packet of that number."""
    packs = F.ceil(F.col("size") / PACKET)
    turn, k = F.floor(slot / packs), slot % packs
    words = F.least(F.lit(PACKET), F.col("size") - k * PACKET)
    return turn, turn * F.col("source_size") + F.col("before") + k * PACKET + words, words


def schedule(queued: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, turn, words, virtual_finish, sid, end, _id: all packets in the global order of virtual finish times.

    A range sort; _id ascends with the order and holds the partition in its upper bits.
    """
    rows = queued.where("size > 0 and target > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PACKET) * most - 1)))
    turn, end, words = _packet(F.col("slot"))
    rows = rows.select("doc_id", turn.alias("turn"), words.alias("words"), (end / F.col("target")).alias("virtual_finish"), "sid", end.alias("end"))
    order = ["virtual_finish", "sid", "end"]
    return kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))


def truncate(packets: DataFrame, budget: int) -> tuple | None:
    """virtual_finish, sid, end of the packet at which the words of the order reach the budget, and its words before the
    cut; None if all packets fit. Sums go over the range partitions first, then inside the one that holds the cut."""
    part = F.shiftright("_id", 33)
    sums = packets.groupBy(part.alias("part")).agg(F.sum("words").alias("words"))  # a row per partition of the sort
    sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("part")))
    found = sums.where(F.col("upto") >= budget).orderBy("part").first()
    if found is None:
        return None
    rows = packets.where(part == found.part).withColumn("upto", F.sum("words").over(Window.partitionBy(part).orderBy("_id")) + F.lit(found.upto - found.words))
    last = rows.where(F.col("upto") >= budget).orderBy("_id").first()
    return last.virtual_finish, last.sid, last.end, last.words - (last.upto - budget)


def _served(queued: DataFrame, share: float, most: int) -> DataFrame:
    """The queue with taken: the words of each document's packets that stand before the cut of the global order."""
    total = sum(r[0] for r in queued.groupBy("sid").agg(F.max("source_size").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).collect())  # one row
    cut = truncate(schedule(queued, most), math.floor(share * total)) if total else None

    def served(slot: Column) -> Column:
        _, end, words = _packet(slot)
        if cut is None:
            return words
        finish = end / F.col("target")
        level, sid, at, left = (F.lit(x) for x in cut)
        early = (finish < level) | (finish == level) & ((F.col("sid") < sid) | (F.col("sid") == sid) & (end < at))
        return F.when(early, words).when((F.col("sid") == sid) & (end == at), left).otherwise(F.lit(0).cast("long"))

    slots = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PACKET) * most - 1)
    taken = F.aggregate(slots, F.lit(0).cast("long"), lambda n, slot: n + served(slot).cast("long"))
    return queued.withColumn("taken", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0).cast("long")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish (of the first pass), text_key; a row per document."""
    rows = _served(queue(docs, weights, share, most), share, most)
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", finish.alias("virtual_finish"), "text_key")


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix as documents, with the columns of docs: each as often as it is taken, the last time cut to the words left."""
    mixed = mix(docs.select("doc_id", "source", "text"), weights, share, most).where("taken > 0")
    mixed = saved(mixed.groupBy("doc_id", "source", "text_key").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("copies")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_key"))
    if mixed.where("copies > 1").limit(1).count():  # equal rows share what is taken of them
        rows = rows.dropDuplicates(["doc_id", "source", "text_key"])
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_key") == F.col("m.text_key")) & F.col("r.source").eqNullSafe(F.col("m.source"))
    rows = rows.alias("r").join(mixed.alias("m"), same).select("row", "size", "taken")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
    left, text = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size")), F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    rows = rows.select(F.col("row").withField("text", F.when(left < F.col("size"), cut).otherwise(text)).alias("row"))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return rows.select("row.*")
