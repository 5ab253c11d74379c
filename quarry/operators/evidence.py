"""Evidence and prompts as text columns: ordered concatenation, documents, sections and templates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import stored
from quarry.functions.dsl import strip
from quarry.operators.resolve import first_n

# Headings of the tools' sections and marks in the templates.
HEADINGS = {
    "kg": "KNOWLEDGE GRAPH INFORMATION",
    "harmonizome": "GENE INFORMATION",
    "wikipedia": "WIKIPEDIA INFORMATION",
    "paperqa_list": "RELATED PAPER LIST",
    "pubmed": "RELATED PAPER LIST",
}
OUTPUT_MARK = "### EXPECTED OUTPUT"
MODIFIERS = ("rephrase", "subgraph", "schema", "ner", "fast")


@dataclass(frozen=True)
class ToolSpec:
    """P10: a tool name taken apart once: base and modifiers."""

    base: str
    modifiers: frozenset[str]

    @classmethod
    def parse(cls, name: str) -> ToolSpec:
        base, *rest = name.split("-")
        unknown = [m for m in rest if m not in MODIFIERS]
        if base not in HEADINGS or unknown:
            raise ValueError(f"unknown tool: {name}")
        return cls(base, frozenset(rest))


def is_kind(perturbation: Column, kind: str) -> Column:
    """A perturbation struct of a type, chemical or genetic."""
    return F.coalesce(perturbation["type"] == kind, F.lit(False))


def concat_in_order(df: DataFrame, keys: list[str], text: str, *order: str, separator: str = "", into: str = "text") -> DataFrame:
    """Texts of a key joined in an explicit order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias(into))


def fan_in(results: DataFrame, key: str = "index") -> DataFrame:
    """Evidence of all tools of a row in declared order; results: key, tool_pos, info."""
    return concat_in_order(results.where("info is not null"), [key], "info", "tool_pos", into="additional_info")


def gene_document(name: Column, symbol: Column, description: Column, synonyms: Column, proteins: Column) -> Column:
    """a gene as text; '' without a name. Nulls inside are left empty. The wording."""
    none = lambda c: F.coalesce(c, F.lit(""))
    lines = F.concat(
        F.lit("\nThe gene name is "), none(name), F.lit(" and the gene symbol is "), none(symbol), F.lit(".\n"), none(description),
        F.lit("\nThe gene synonyms are "), none(F.array_join(synonyms, ", ")), F.lit(".\nThe gene is related to the proteins "), none(F.array_join(proteins, ", ")), F.lit(".\n\n"),
    )
    return F.when(name.isNull(), F.lit("")).otherwise(lines)


def related_genes(associations: DataFrame, gene_set: str, symbol: str, pos: str, most: int = 20) -> DataFrame:
    """Per gene set its first distinct symbols in order."""
    early = associations.where(F.col(pos) < most)
    return early.groupBy(gene_set, symbol).agg(F.min(pos).alias(pos))


def subgraph_text(edges: DataFrame, nodes: DataFrame, types: DataFrame, most: int = 500) -> DataFrame:
    """one row with the text of an edge list (edge_id, src, dst, type_id; pos orders it), its first edges only. The wording."""
    chosen = edges.orderBy("pos").limit(most)
    ends = chosen.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    node = ends.join(nodes, "node_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "doc"))), lambda r: F.concat(F.lit("- Node ID: "), r["node_id"].cast("string"), F.lit(", Doc Info: "), r["doc"])), "\n").alias("node_lines"))
    label = F.concat(F.lit("- Node ID "), F.col("src").cast("string"), F.lit(" is connected to Node ID "), F.col("dst").cast("string"), F.lit(" with edge type: "), F.col("label"))
    edge = chosen.join(types, "type_id").agg(F.count("*").alias("m"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", label.alias("t")))), lambda r: r["t"]), "\n").alias("edge_lines"))
    text = F.concat(F.lit("The retrieved subgraph contains "), F.col("n").cast("string"), F.lit(" nodes and "), F.col("m").cast("string"), F.lit(" edges.\n\nNodes:\n"), F.col("node_lines"), F.lit("\n\nConnections:\n"), F.col("edge_lines"))
    return node.join(edge, F.lit(True)).select(text.alias("text"))  # one row on either side


def subgraph_texts(edges: DataFrame, nodes: DataFrame, types: DataFrame, most: int = 500) -> DataFrame:
    """F14 of all records: index, text of edges (index, edge_id, src, dst, type_id; pos orders them), the first of each record only,
    so a record's text is gathered from so many edges at most. Fixed values: the wording is that of subgraph_text."""
    chosen = stored(first_n(edges, ["index"], most, F.col("pos")))
    ends = chosen.select("index", F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(nodes.select("node_id", "doc"), "node_id")
    lines = lambda parts: F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda r: r["t"]), "\n")
    doc = F.concat(F.lit("- Node ID: "), F.col("node_id").cast("string"), F.lit(", Doc Info: "), "doc")
    node = ends.groupBy("index").agg(F.count("*").alias("n"), lines(F.struct("node_id", doc.alias("t"))).alias("node_lines"))
    label = F.concat(F.lit("- Node ID "), F.col("src").cast("string"), F.lit(" is connected to Node ID "), F.col("dst").cast("string"), F.lit(" with edge type: "), "label")
    edge = chosen.join(types.select("type_id", "label"), "type_id").groupBy("index").agg(F.count("*").alias("m"), lines(F.struct("pos", label.alias("t"))).alias("edge_lines"))
    text = F.concat(F.lit("The retrieved subgraph contains "), F.col("n").cast("string"), F.lit(" nodes and "), F.col("m").cast("string"), F.lit(" edges.\n\nNodes:\n"), "node_lines", F.lit("\n\nConnections:\n"), "edge_lines")
    return node.join(edge, "index").select("index", text.alias("text"))


def section(info: Column, tool: ToolSpec) -> Column:
    """F16 without schema: heading, text, blank line."""
    return F.concat(F.lit(f"## {HEADINGS[tool.base]}\n"), F.coalesce(info, F.lit("None")), F.lit("\n\n"))


def node_records(info: Column) -> Column:
    """F16 of graph text: an array (one per blank-line block) of arrays of {key: value}."""
    blocks = F.split(info, "\n\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    fields = lambda b: F.filter(F.transform(F.split(b, "- ", -1), strip), lambda e: F.contains(e, F.lit(":")))
    pair = lambda e: F.create_map(strip(F.substring_index(e, ":", 1)), strip(F.regexp_replace(e, "^[^:]*:", "")))
    return F.transform(blocks, lambda b: F.transform(fields(b), pair))


def schema_text(info: Column, tool: str) -> Column:
    """F16: evidence of a tool with the modifier schema, as JSON. Gene and paper evidence are arrays of structs already."""
    if "kg" in tool:
        return F.to_json(F.struct(node_records(info).alias("KG nodes")))
    if "harmonizome" in tool:
        return F.to_json(F.struct(info.alias("Gene information")), {"ignoreNullFields": "false"})
    if "wikipedia" in tool:
        return F.to_json(F.struct(heading_records(info).alias("wikipedia_info")))
    if "paperqa" in tool:
        return F.to_json(F.struct(info.alias("paperqa_info")), {"ignoreNullFields": "false"})
    return F.when(info.isNotNull(), F.lit("{}"))


def gene_records(genes: DataFrame, sets: DataFrame, related: DataFrame, key: str = "index") -> DataFrame:
    """F16 of gene evidence: key, info: an array of structs, genes (key, name, symbol, description) first, then gene sets
    (key, name) with their related genes (name, pos, symbol)."""
    lists = related.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda r: r["symbol"]).alias("related_genes"))
    one = genes.select(key, F.lit(0).alias("part"), F.col("name").alias("gene_name"), F.lit(None).cast("string").alias("gene_set_name"), "symbol", "description", F.lit(None).cast("array<string>").alias("related_genes"))
    two = sets.join(lists, "name", "left").select(key, F.lit(1).alias("part"), F.lit(None).cast("string").alias("gene_name"), F.col("name").alias("gene_set_name"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("description"), "related_genes")
    rows = one.unionByName(two).withColumn("r", F.struct("part", F.coalesce("gene_name", "gene_set_name").alias("name"), F.struct("gene_name", "gene_set_name", "symbol", "description", "related_genes").alias("v")))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["v"]).alias("info"))


def heading_records(info: Column) -> Column:
    """F16 of encyclopedia text: array of (entity_name, context) of the ## sections."""
    parts = F.filter(F.split(info, "##", -1), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("entity_name"), F.when(F.contains(p, F.lit("\n")), strip(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise(F.lit("")).alias("context")))


def report_prompt(template: str, treatment: Column, info: Column) -> Column:
    """the treatment in the template, and evidence, if any, before the mark of the expected output."""
    filled = F.replace(F.lit(template.replace("{{", "{").replace("}}", "}")), F.lit("{treatment}"), treatment)
    extra = F.concat(F.lit("\n# ADDITIONAL INFORMATION\n"), info, F.lit("\nPlease use the additional information to generate the report."))
    at = F.locate(OUTPUT_MARK, filled)
    with_info = F.concat(F.substring(filled, F.lit(1), at - 1), extra, F.substring(filled, at, F.length(filled)))
    return F.when((F.length(F.coalesce(info, F.lit(""))) > 0) & (at > 0), with_info).otherwise(filled)


def explain_prompt(template: str, **values: Column) -> Column:
    """all values in the template; empty evidence takes its heading away."""
    filled = F.lit(template.replace("{{", "{").replace("}}", "}"))
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    if "information" in values:
        filled = F.when(F.length(F.coalesce(values["information"], F.lit(""))) == 0, F.replace(filled, F.lit("## Additional information\n"), F.lit(""))).otherwise(filled)
    return filled


def relax(entities: list[str], search: Callable[[str], DataFrame], enough: int, key: str) -> DataFrame:
    """Search for all entities, then for one fewer at a time, until there are enough distinct hits.

    One bounded loop on the driver over the caller's few entities; hits stay distributed.
    """
    found, names = None, list(entities)
    while names:
        hits = search(",".join(names)).withColumn("_round", F.lit(len(entities) - len(names)))
        found = hits if found is None else found.unionByName(hits)
        if found.select(key).distinct().limit(enough).count() >= enough:
            break
        names.pop()
    first = found.groupBy(key).agg(F.min("_round").alias("round"))
    return first.orderBy("round", key).limit(enough)


def relax_each(queries: DataFrame, postings: DataFrame, enough: int, key: str = "doc_id") -> DataFrame:
    """T07 of all records in one plan: index, key, round, place of the first `enough` hits of each record.

    queries: index, pos, term, in order of pos from 0; postings: term, key. A hit of round r holds all terms but the last r. How many
    leading terms a document holds says in which round it is first found, and rounds only grow, so the first by round and
    key are what a search for fewer and fewer terms gives until it has enough: each record stops where it has. Counting
    goes over documents of a record's first term alone. Records without a hit have no row; null terms match nothing, and
    rows that repeat count once.
    """
    asked = queries.select("index", "pos", "term").distinct()
    terms = asked.groupBy("index").agg((F.max("pos") + 1).alias("_terms"))
    held = postings.where(F.col(key).isNotNull()).join(asked.select("term").distinct(), "term", "left_semi").select("term", key).distinct()
    met = stored(asked.join(held, "term").select("index", "pos", key))
    first = met.where("pos = 0").select("index", key)
    rows = met.join(first, ["index", key], "left_semi").groupBy("index", key).agg(F.sort_array(F.collect_set("pos")).alias("_at"))  # no more than a record's terms
    lead = F.aggregate("_at", F.lit(0), lambda n, p: F.when(p == n, n + 1).otherwise(n))
    hits = rows.select("index", key, lead.alias("_lead")).join(terms, "index").select("index", key, (F.col("_terms") - F.col("_lead")).alias("round"))
    place = F.row_number().over(Window.partitionBy("index").orderBy("round", key))
    return hits.withColumn("place", place).where(F.col("place") <= enough)
