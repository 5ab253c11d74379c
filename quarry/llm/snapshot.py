"""Difference of two snapshots by key, with rows that came back under another key.

A full outer sort-merge join pairs rows of equal key. Rows left on either side are numbered within their content in
ascending order of key, and a join on content and number finds those that were only rekeyed. Columns are compared by
digest, so no text moves; a number within a content comes from a global range sort, so no content, however many rows
share it, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def digest(column: Column) -> Column:
    """16 bytes that tell values apart; null stays null."""
    return F.unhex(F.md5(column.cast("string").cast("binary")))


def described(df: DataFrame, key: str, columns: list[str], ordered: tuple[str, ...]) -> DataFrame:
    """A narrow row: key, a digest a column (c0, c1, ...), content (all of them, null told apart), and the row's sha256.

    The latter is of the values joined by line feeds, a null as `~`, in lower-case hex.
    """
    values = [digest(F.col(c)) for c in columns]
    whole = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ordered))
    rows = df.select(F.col(key).alias("key"), *(v.alias(f"c{k}") for k, v in enumerate(values)), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sha"))
    return rows.withColumn("content", F.unhex(F.md5(F.concat(*(F.coalesce(F.hex(f"c{k}"), F.lit("~")) for k in range(len(columns))), F.lit("")).cast("binary"))))


def numbered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """place: the number of a row among those of equal group (null is a group) in this order, from 1.

    Rows are dealt by range of group and order, so a large group spreads over as many partitions as it needs. It is numbered in
    each, and what it has in those before is added: only the first group of a partition can have rows before, so there is at most
    one such sum a partition, and the table that is broadcast has no more rows than there are partitions.
    """
    rows = saved(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    held = F.struct(group)
    edges = rows.groupBy("_part").agg(F.min(held).alias("_low"), F.max(held).alias("_high"))
    crossing = edges.select(F.col("_high").alias("_of")).join(edges.select(F.col("_low").alias("_of")), "_of").distinct()
    sizes = rows.withColumn("_of", held).join(F.broadcast(crossing), "_of", "left_semi").groupBy("_of", "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_of", "_part", F.sum("_size").over(earlier).alias("_before"))
    here = Window.partitionBy(group, "_part").orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(here)).withColumn("_of", held)
    return placed.join(F.broadcast(before), ["_of", "_part"], "left").withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0))).drop("_of", "_part", "_before")


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, old_key, op (same, update, rekey, insert, delete), changed, row_sha256: a row a pair or unpaired row.

    Nulls, as keys and in columns, equal nulls only. Rows that repeat a key pair in the order of their contents: i-th earlier
    with i-th later, and what one side has more of is unpaired. Other columns of the tables, whatever their names, play no
    part. Two empty tables have no difference. row_sha256 is null for deleted rows.
    """
    old = numbered(described(earlier, key, columns, tuple(columns)), "key", F.col("content"))
    new = numbered(described(later, key, columns, tuple(columns)), "key", F.col("content"))
    old = old.select(*(F.col(c).alias(f"old_{c}") for c in old.columns), F.lit(True).alias("was"))
    new = new.withColumn("now", F.lit(True))
    met = saved(old.hint("merge").join(new, F.col("old_key").eqNullSafe(F.col("key")) & (F.col("old_place") == F.col("place")), "full_outer"))

    paired = met.where("was AND now")
    parts = [F.when(~F.col(f"old_c{k}").eqNullSafe(F.col(f"c{k}")), F.lit(c)) for k, c in enumerate(columns)]
    changed = F.concat_ws(",", *parts)
    pairs = paired.select("key", "old_key", F.when(changed == "", "same").otherwise("update").alias("op"), changed.alias("changed"), F.lower(F.hex("sha")).alias("row_sha256"))

    gone = numbered(met.where("now IS NULL").select("old_key", F.col("old_content").alias("content"), "was"), "content", F.col("old_key"))
    come = numbered(met.where("was IS NULL").select("key", "content", "now", "sha"), "content", F.col("key"))
    rest = gone.hint("merge").join(come, ["content", "place"], "full_outer")
    op = F.when(F.col("was") & F.col("now"), "rekey").when(F.col("now"), "insert").otherwise("delete")
    moved = rest.select(F.when(F.col("now"), F.col("key")).otherwise(F.col("old_key")).alias("key"), "old_key", op.alias("op"), F.lit("").alias("changed"), F.lower(F.hex("sha")).alias("row_sha256"))
    return pairs.unionByName(moved)


def later_documents(docs: DataFrame) -> DataFrame:
    """A later snapshot of documents: by crc32 of the decimal doc_id modulo 10, rows go (0), get `+` at their text (1), swap
    lang and source (2), change their key to -1-key (3), do so and lose their source (4), or get a copy under that key (5).
    A row without an id stays as it is."""
    kind = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9))
    other = F.lit(-1) - F.col("doc_id")
    keys = F.when(kind.isin(3, 4), F.array(other)).when(kind == 5, F.array(F.col("doc_id"), other)).otherwise(F.array("doc_id"))
    rows = docs.select("doc_id", "text", "lang", "source").where(kind != 0)
    return rows.select(
        F.explode(keys).alias("doc_id"),
        F.when(kind == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(kind == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(kind == 2, F.col("lang")).when(kind != 4, F.col("source")).alias("source"),
    )
