"""Entity resolution and the keyed joins around it; all declarative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import cut


def last_wins(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Per key the value that comes last in the order (max_by: partial aggregation, no sort)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_wins(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def merge_maps(first: DataFrame, second: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Union of two entry tables; the second one and then the last entry wins."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return last_wins(both, keys, value, "_side", pos)


def candidate(df: DataFrame, key: Column, node: Column, priority: int, tag: str | None = None, fold: bool = True, pos: Column | None = None) -> DataFrame:
    """A lookup of the cascade: key, node_id, priority, tag, fold. Of equal keys the last by pos stays."""
    rows = df.select(key.alias("key"), node.cast("long").alias("node_id"), (node if pos is None else pos).alias("_pos")).where("key is not null")
    return last_wins(rows, ["key"], "node_id", "_pos").select("key", "node_id", F.lit(priority).alias("priority"), F.lit(tag).cast("string").alias("for_tag"), F.lit(fold).alias("fold"))


def resolve(mentions: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """Entity, tag, node_id, priority of the first lookup that knows the entity; null where none does, or without any lookup.

    mentions: entity, tag. Each distinct mention is looked up once: by its lower case where `fold`, else as it is, in
    the lookups without tag or of its own. The order is data: one left join over all lookups and one aggregation.
    """
    asked = mentions.select("entity", "tag").distinct()
    if not candidates:
        return asked.select("entity", "tag", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("int").alias("priority"))
    both = F.array(F.struct(F.lower("entity").alias("key"), F.lit(True).alias("fold")), F.struct(F.col("entity").alias("key"), F.lit(False).alias("fold")))
    keys = asked.select("entity", "tag", F.inline(both))
    table = reduce(DataFrame.unionByName, candidates)
    same = (keys["key"] == table["key"]) & (keys["fold"] == table["fold"]) & (table["for_tag"].isNull() | table["for_tag"].eqNullSafe(keys["tag"]))
    hits = keys.join(table, same, "left").select("entity", "tag", "node_id", "priority")
    return hits.groupBy("entity", "tag").agg(F.min_by("node_id", "priority").alias("node_id"), F.min("priority").alias("priority"))


def unmatched(resolved: DataFrame) -> DataFrame:
    return resolved.where("node_id is null").select("entity", "tag")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a former run has not done."""
    return rows.join(done.select(key), key, "left_anti")


def align(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner join by key; columns get _gt and _gen."""
    name = lambda df, end: df.select(key, *(F.col(c).alias(c + end) for c in df.columns if c != key))
    return name(truth, "_gt").join(name(found, "_gen"), key)


def misaligned(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    return truth.select(key, F.lit(True).alias("_a")).join(found.select(key, F.lit(True).alias("_b")), key, "full").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "gen").otherwise("gt").alias("only_in"))


def edge_ids(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The least edge id of each distinct wanted (src, dst) and how many parallel edges there are; -1 and 0 if missing.

    Wanted pairs and edges are counted together by one aggregation that begins before the shuffle, so parallel edges neither meet nor are
    sorted in one task. Null ends match nothing.
    """
    asked = wanted.select("src", "dst", F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"), F.lit(True).alias("_asked"))
    held = edges.where("src is not null and dst is not null").select("src", "dst", "edge_id", F.lit(False).alias("_asked"))
    rows = asked.unionByName(held).groupBy("src", "dst").agg(F.coalesce(F.min("edge_id"), F.lit(-1)).alias("edge_id"), F.count("edge_id").alias("n"), F.max("_asked").alias("_asked"))
    return rows.where("_asked").drop("_asked")


def without(df: DataFrame, ignore: tuple[str, ...] = ("index",)) -> DataFrame:
    """The columns, and the fields of nested structs, that aren't ignored."""

    def stripped(column: Column, kind) -> Column:
        if kind.typeName() == "struct":
            fields = [stripped(column[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in ignore]
            return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
        if kind.typeName() == "array":
            return F.transform(column, lambda x: stripped(x, kind.elementType))
        if kind.typeName() == "map":
            return F.transform_values(column, lambda _, v: stripped(v, kind.valueType))
        return column

    return df.select(*(stripped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name not in ignore))


def dedupe(df: DataFrame, pos: str, keep: str = "first", ignore: tuple[str, ...] = ("index",), multiset: bool = False, drop_ignored: bool = False) -> DataFrame:
    """One of the rows that agree in all but the ignored columns and pos; the first or last by pos, order kept.

    Nested fields are compared in order of their names, ignored at every depth; multiset: arrays as multisets. A null pos comes
    after all others; of equal positions the row of least (or largest) digest stays. drop_ignored takes the ignored columns
    and fields out of the result.
    """

    def frozen(column: Column, kind) -> Column | None:
        if kind.typeName() == "struct":
            fields = [(f.name, frozen(column[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in ignore]
            return F.when(column.isNotNull(), F.to_json(F.struct(*(c.alias(n) for n, c in fields)))) if fields else F.lit("{}")
        if kind.typeName() == "array":
            parts = F.transform(column, lambda x: F.coalesce(frozen(x, kind.elementType).cast("string"), F.lit("\0null")))
            return F.to_json(F.array_sort(parts) if multiset else parts)
        if kind.typeName() == "map":
            entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("\0", e["key"].cast("string"), F.coalesce(frozen(e["value"], kind.valueType).cast("string"), F.lit("\0null"))))
            return F.to_json(F.array_sort(entries))
        return column

    columns = {f.name: frozen(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name != pos and f.name not in ignore}
    # partial aggregation on a digest of the key; whole rows aren't moved for a window
    digest = F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(columns.items()))), {"ignoreNullFields": "false"}), 256)
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    pick = F.min if keep == "first" else F.max
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumns({"_key": digest, "_row": whole})
    chosen = rows.groupBy("_key").agg(pick(F.struct(F.col(pos).isNull().alias("last"), F.col(pos).alias("pos"), "_row")).alias("_p")).select("_key", F.col("_p.pos").alias("_pos"), F.col("_p._row").alias("_row"))
    here = (rows["_key"] == chosen["_key"]) & (rows["_row"] == chosen["_row"]) & rows[pos].eqNullSafe(chosen["_pos"])
    kept = rows.join(chosen, here, "left_semi").dropDuplicates(["_key", "_row"]).drop("_key", "_row")
    return without(kept, ignore) if drop_ignored else kept


def first_n(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first n of each group that passed the filters so far."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def positions(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """0-based places in a total order, from a range sort and prefix sums of partition sizes."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_part", part).join(F.broadcast(sizes.select("_part", "_base")), "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_base")
