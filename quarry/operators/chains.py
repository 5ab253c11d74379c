"""The lookups of entity resolution put together: name, alias and drug dimensions (G07), the cascade of each kind of entity
(J01) and the graph evidence of records (X09). All declarative: every lookup is a table, their order is data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import stored
from quarry.functions import dsl
from quarry.operators import cells, evidence, graph, resolve, vectors


def names(nodes: DataFrame, fold: bool = True) -> DataFrame:
    """Key, node_id of nodes (node_id, name): the last node of a name, or of its lower case."""
    key = F.lower("name") if fold else F.col("name")
    return resolve.last_wins(nodes.select(key.alias("key"), "node_id").where("key is not null"), ["key"], "node_id", "node_id")


def gene_aliases(info: DataFrame, nodes: DataFrame) -> DataFrame:
    """Alias, node_id of info (pos, name, type, aliases): genes and proteins only; the last gene of an alias wins."""
    rows = info.where("type = 'gene/protein'").select("name", "pos", F.explode("aliases").alias("alias"))
    return resolve.last_wins(rows.join(names(nodes, fold=False), F.col("name") == F.col("key")), ["alias"], "node_id", "pos")


def drug_names(info: DataFrame) -> DataFrame:
    """drug_id, name of info (pos, id, name, type): drugs only; the last name of an id wins."""
    rows = info.where("type = 'drug'").select(F.col("id").alias("drug_id"), "name", "pos")
    return resolve.last_wins(rows, ["drug_id"], "name", "pos")


def by_name(nodes: DataFrame) -> list[DataFrame]:
    """The first lookups of every entity: its lower case among the lower names, then itself among the names."""
    return [resolve.candidate(nodes, F.lower("name"), F.col("node_id"), 1), resolve.candidate(nodes, F.col("name"), F.col("node_id"), 2, fold=False)]


def for_diseases(labels: DataFrame, synonyms: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """A label of the ontology (label), or a synonym (synonym, label) of one if it isn't a label itself, by the node of that name."""
    named = names(nodes, fold=False)
    own = labels.select(F.col("label").alias("entity"), F.col("label").alias("name")).distinct()
    other = synonyms.join(labels.select(F.col("label").alias("synonym")).distinct(), "synonym", "left_anti").join(labels.select("label").distinct(), "label").select(F.col("synonym").alias("entity"), F.col("label").alias("name"))
    rows = own.withColumn("_p", F.lit(3)).unionByName(other.withColumn("_p", F.lit(4))).join(named, F.col("name") == F.col("key"))
    return [resolve.candidate(rows.where(F.col("_p") == p), F.col("entity"), F.col("node_id"), p, "Disease", fold=False) for p in (3, 4)]


def for_chemicals(aliases: DataFrame, drugs: DataFrame, nodes: DataFrame, compounds: DataFrame | None = None) -> list[DataFrame]:
    """An alias (alias_lc, priority, drug_id) or, if no drug has it, the first synonym DB... of the compound of that name
    (name, synonyms): the drug's name (drug_id, name), then the node of that name."""
    known = resolve.first_wins(aliases, ["alias_lc"], "drug_id", "priority")
    rows = known.select(F.col("alias_lc").alias("entity"), "drug_id").withColumn("_p", F.lit(3))
    if compounds is not None:
        found = compounds.select(F.lower("name").alias("entity"), dsl.first_with_prefix(F.col("synonyms"), "DB").alias("drug_id")).where("drug_id is not null")
        found = found.join(known.select(F.col("alias_lc").alias("entity")), "entity", "left_anti")
        rows = rows.unionByName(found.groupBy("entity").agg(F.min("drug_id").alias("drug_id")).withColumn("_p", F.lit(4)))
    rows = rows.join(drugs.select("drug_id", "name"), "drug_id").join(names(nodes, fold=False), F.col("name") == F.col("key"))
    return [resolve.candidate(rows.where(F.col("_p") == p), F.col("entity"), F.col("node_id"), p, "Chemical") for p in ((3, 4) if compounds is not None else (3,))]


def for_genes(aliases: DataFrame) -> list[DataFrame]:
    """aliases: alias, node_id."""
    return [resolve.candidate(aliases, F.col("alias"), F.col("node_id"), 3, "Gene", fold=False)]


def kg_nodes(mentions: DataFrame, candidates: list[DataFrame], nodes: DataFrame, encoder, k: int = 1, index: cells.Index | None = None) -> DataFrame:
    """index, node_id: the nodes of each record's entities (index, entity, tag); an entity that no lookup knows brings the
    k nodes (node_id, embedding) nearest to its own vector, made once per distinct entity, by the index of the nodes (made here if
    none is given)."""
    found = resolve.resolve(mentions, candidates)
    rows = mentions.select("index", "entity", "tag").distinct()
    same = (F.col("m.entity") == F.col("f.entity")) & F.col("m.tag").eqNullSafe(F.col("f.tag"))
    known = rows.alias("m").join(found.where("node_id is not null").alias("f"), same).select("index", "node_id")
    missing = resolve.unmatched(found).select("entity").distinct()
    asked = vectors.embed(missing, "entity", encoder).select(F.col("entity").alias("query_id"), "embedding")
    near = cells.search(index or cells.build(nodes), asked, k).select(F.col("query_id").alias("entity"), "node_id")
    guessed = rows.alias("m").join(resolve.unmatched(found).alias("f"), same).select("index", "m.entity").join(near, "entity").select("index", "node_id")
    return known.unionByName(guessed).distinct()


def kg_info(mentions: DataFrame, candidates: list[DataFrame], nodes: DataFrame, encoder, docs: DataFrame, k: int = 1) -> DataFrame:
    """Index, node_list, info: the documents (node_id, doc) of a record's nodes, in order of their ids, a blank line after each."""
    rows = kg_nodes(mentions, candidates, nodes, encoder, k).join(docs.select("node_id", "doc"), "node_id").withColumn("doc", F.concat("doc", F.lit("\n\n")))
    text = evidence.concat_in_order(rows, ["index"], "doc", "node_id", into="info")
    ids = rows.groupBy("index").agg(F.transform(F.sort_array(F.collect_list("node_id")), lambda x: x.cast("string")).alias("node_list"))
    return ids.join(text, "index")


def kg_subgraph_info(nodes: DataFrame, edges: DataFrame, docs: DataFrame, types: DataFrame, most: int = 500, hops: int | None = None) -> DataFrame:
    """X09 of all records at once: index, node_list, subgraph (edge ids in order), info: the text of the graph that connects a record's
    nodes (index, node_id, as of kg_nodes). edges: edge_id, src, dst, type_id. A record without an edge between its nodes has
    the text of none."""
    found = stored(graph.connecting_subgraphs(edges.select("edge_id", "src", "dst", "type_id"), nodes, hops))
    text = evidence.subgraph_texts(found.withColumn("pos", F.col("edge_id")), docs, types, most)
    ids = found.groupBy("index").agg(F.sort_array(F.collect_list("edge_id")).alias("subgraph"))
    listed = nodes.select("index", "node_id").distinct().groupBy("index").agg(F.transform(F.sort_array(F.collect_list("node_id")), lambda x: x.cast("string")).alias("node_list"))
    none = F.lit("The retrieved subgraph contains 0 nodes and 0 edges.\n\nNodes:\n\nConnections:")  # Fixed value: the wording for no edges
    rows = listed.join(ids, "index", "left").join(text, "index", "left")
    return rows.select("index", "node_list", F.coalesce("subgraph", F.array().cast("array<long>")).alias("subgraph"), F.coalesce("text", none).alias("info"))


def gene_evidence(records: DataFrame, genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Index, info of records (index, context, perturbations): target genes, gene sets of the names of chemicals and of
    the cell type, each with its heading, in that order.

    genes: name, doc; sets: name, text (related genes and their documents), both without failed lookups.
    """
    p = records.select("index", F.posexplode("perturbations").alias("pos", "p"), F.get("context", F.lit(0))["cell_type"].alias("cell"))
    target = p.where(evidence.is_kind(F.col("p"), "chemical")).select("index", F.explode("p.known_targets").alias("name"))
    target = target.unionByName(p.where(evidence.is_kind(F.col("p"), "genetic")).select("index", F.col("p.gene_symbol").alias("name"))).distinct()
    chemical = p.where(evidence.is_kind(F.col("p"), "chemical")).groupBy("index", F.col("p.name").alias("name")).agg(F.min("pos").alias("pos"))
    cell = p.select("index", F.col("cell").alias("name")).distinct()
    # The headings of the parts.
    parts = [
        (target.withColumn("pos", F.lit(0)), genes.select("name", F.col("doc").alias("text")), "### TARGET GENE INFORMATION\nThe target gene of the perturbation is "),
        (chemical, sets.select("name", "text"), "### PERTURBATION NAME INFORMATION\nThe perturbation name is "),
        (cell.withColumn("pos", F.lit(0)), sets.select("name", "text"), "### CELL TYPE INFORMATION\nThe cell type of the context is "),
    ]
    rows = [a.where("name <> ''").join(b, "name").select("index", F.lit(k).alias("part"), F.col("pos").cast("long").alias("pos"), "name", F.concat(F.lit(head), "name", F.lit(". "), "text").alias("text")) for k, (a, b, head) in enumerate(parts)]
    return evidence.concat_in_order(reduce(DataFrame.unionByName, rows), ["index"], "text", "part", "pos", "name", into="info")


def gene_set_text(related: DataFrame, genes: DataFrame) -> DataFrame:
    """Name, text of related (name, pos, symbol) with the documents of genes (name, doc); genes without one are left empty."""
    rows = related.join(genes.select(F.col("name").alias("symbol"), "doc"), "symbol", "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    both = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "doc"))).alias("r"))
    listed = F.array_join(F.transform("r", lambda x: x["symbol"]), ", ")
    return both.select("name", F.concat(F.lit("\nThe related genes are "), listed, F.lit(".\n\nThe gene information is as follows:\n"), F.array_join(F.transform("r", lambda x: x["doc"]), "")).alias("text"))


def disease_model_evidence(records: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """X08 of records of one perturbation: index, info: the gene set of the first word of the disease model that has one.

    records: index, disease_model; found: index, word, as of providers.first_success over words(); sets: name, text. Records without
    such a word, and words without a text, have no row.
    """
    rows = records.where("disease_model is not null").join(found.select("index", "word"), "index").join(sets.select(F.col("name").alias("word"), "text"), "word")
    # Fixed value: the heading.
    return rows.select("index", F.concat(F.lit("### DISEASE MODEL INFORMATION\nThe disease model of the context is "), "disease_model", F.lit(". "), "text").alias("info"))


def words(records: DataFrame, column: str) -> DataFrame:
    """index, pos, word of a text column, cut at white space."""
    return records.select("index", F.posexplode(F.split(dsl.strip(F.col(column)), r"\s+")).alias("pos", "word")).where("word <> ''")


def paper_list(entities: DataFrame, postings: DataFrame, papers: DataFrame, most: int = 10) -> DataFrame:
    """X09 of literature by search: index, papers: the first papers (title, abstract, by round and doc_id) that hold a record's
    entities (index, pos, entity), the last one dropped again and again until there are enough.

    postings: term, doc_id; papers: doc_id, title, abstract; those without either count among the most, and are left out after.
    """
    asked = entities.select("index", "pos", F.col("entity").alias("term"))
    hits = evidence.relax_each(asked, postings, most).join(papers.select("doc_id", "title", "abstract"), "doc_id")
    return _listed(hits.where("title is not null and abstract is not null"), "place")


def nearest_paper_list(queries: DataFrame, corpus: DataFrame, encoder, most: int = 30, spare: int = 10, index: cells.Index | None = None) -> DataFrame:
    """X09 of literature by vectors: index, papers: of the most + spare papers (node_id, title, abstract, embedding) nearest to each query
    (index, query), the first `most` that have an abstract."""
    asked = vectors.embed(queries.select("query").where("query is not null").distinct(), "query", encoder)
    near = cells.search(index or cells.build(corpus), asked, most + spare, query_key="query")
    usable = corpus.select("node_id", "title", "abstract").where("abstract is not null and abstract <> 'Abstract not found'")
    rows = queries.select("index", "query").join(near, "query").join(usable, "node_id")
    return _listed(resolve.first_n(rows, ["index"], most, F.col("rank")), "rank")


def _listed(rows: DataFrame, order: str) -> DataFrame:
    """index, papers: structs of title and abstract in order; a bounded number a record."""
    return rows.groupBy("index").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "title", "abstract"))), lambda r: F.struct(r["title"].alias("title"), r["abstract"].alias("abstract"))).alias("papers"))
