"""Keyed connectors (S13-S15, S19-S21, S23, S24): request keys as columns, one call per distinct key, replies as columns.

Every function takes a provider (operators.providers), so an offline stub or a replay table can stand for the service;
http() is the provider for real ones. Failed calls leave a row with `error` and no values.
"""

from __future__ import annotations

import gzip
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import cut, shared_base
from quarry.functions import dsl
from quarry.operators import cells, evidence, providers, resolve

GENE = "name string, symbol string, description string, synonyms array<string>, proteins array<struct<symbol:string>>, status string"
GENE_SET = "geneSets array<struct<name:string,href:string>>, status string"
ASSOCIATIONS = "associations array<struct<gene:struct<symbol:string>>>"
PAGE = "entities array<struct<name:string,href:string>>, next string"
PAPER = "pmid string, title string, authors array<string>, abstract string, publication_year string"


def http(base: str, timeout: float = 10.0) -> Callable[[], providers.Provider]:
    """GET base + request; errors of the service become a JSON status, as its own client would give them."""

    def make() -> providers.Provider:
        def get(request: str) -> str:
            try:
                with urllib.request.urlopen(base + request, timeout=timeout) as reply:
                    return reply.read().decode("utf-8")
            except urllib.error.HTTPError:
                return json.dumps({"status": "error"})

        return lambda requests: [get(r) for r in requests]

    return make


def fetch(keys: DataFrame, request: Column, schema: str, make, replay: DataFrame | None = None) -> DataFrame:
    """The rows of keys with the parsed reply as struct `r`, `error`, and `status` rows turned into errors."""
    asked = keys.withColumn("_request", request)
    rows = providers.join_back(asked, "_request", providers.call_once(asked, "_request", make, replay), "_reply")
    parsed = rows.withColumn("r", F.from_json("_reply", schema))
    failed = F.coalesce(F.col("_reply_error"), F.when(F.get_json_object("_reply", "$.status").isNotNull(), "status"), F.when(F.col("_reply").isNotNull() & F.col("r").isNull(), "unreadable"))
    return parsed.withColumn("error", failed).withColumn("r", F.when(failed.isNull(), F.col("r"))).drop("_request", "_reply", "_reply_error")


def genes(names: DataFrame, make, replay: DataFrame | None = None) -> DataFrame:
    """Name, doc, error."""
    rows = fetch(names.select("name").where("name <> ''").distinct(), F.concat(F.lit("gene/"), dsl.quote(F.col("name"), plus=True)), GENE, make, replay)
    return rows.select("name", evidence.gene_document(F.col("r.name"), F.col("r.symbol"), F.col("r.description"), F.col("r.synonyms"), F.col("r.proteins.symbol")).alias("doc"), "error")


def gene_sets(names: DataFrame, make, most: int = 20) -> DataFrame:
    """Name, pos, symbol of the first genes of the first gene set."""
    sets = fetch(names.select("name").where("name <> ''").distinct(), F.concat(F.lit("gene_set/"), dsl.quote(F.col("name"), plus=True)), GENE_SET, make)
    first = sets.select("name", F.get("r.geneSets", F.lit(0))["href"].alias("href")).where("href is not null")
    rows = fetch(first, F.col("href"), ASSOCIATIONS, make)
    found = rows.select("name", F.posexplode("r.associations.gene.symbol").alias("pos", "symbol")).where("symbol is not null")
    return evidence.related_genes(found, "name", "symbol", "pos", most)


def pages(spark: SparkSession, start: str, make, at_once: int = 1000) -> DataFrame:
    """Pos, request, reply of a cursor, page after page; stops at a missing link, a failure or a loop.

    A cursor is one chain of calls; replies go to the shared folder a batch at a time, so the driver holds no more.
    """
    provider, request, seen, held, path = make(), start, set(), [], f"{shared_base(spark)}/pages-{uuid.uuid4().hex}"
    schema = "pos long, request string, reply string"
    keep = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    while request and request not in seen:
        reply, link = None, None
        try:
            reply = provider([request])[0]
            link = json.loads(reply).get("next")
        except Exception:  # the failing page is the last one
            pass
        held.append((len(seen), request, reply))
        seen.add(request)
        if len(held) >= at_once:
            keep(held)
            held = []
        request = link
    keep(held)
    return spark.read.schema(schema).parquet(path)


def entities(found: DataFrame) -> DataFrame:
    """Page, pos, name, href of the entities of pages()."""
    rows = found.select(F.col("pos").alias("page"), F.posexplode(F.from_json("reply", PAGE)["entities"]).alias("pos", "e"))
    return rows.select("page", "pos", "e.name", "e.href")


def catalog(spark: SparkSession, make) -> tuple[DataFrame, DataFrame]:
    """Dataset, path, and the names of the downloads (pos, download) of the service's configuration: one call, made when asked for."""
    reply = spark.createDataFrame([(make()(["dark/script_config"])[0],)], "reply string").select(F.from_json("reply", "datasets map<string,string>, downloads array<string>").alias("r"))
    return reply.select(F.explode("r.datasets").alias("dataset", "path")), reply.select(F.posexplode("r.downloads").alias("pos", "download"))


def downloads(sets: DataFrame, wanted: DataFrame, make, done: DataFrame | None = None) -> DataFrame:
    """Dataset, download, content, error of wanted (dataset, download) files, one task a file; files of `done` are left out.

    sets: dataset, path. make() gives a function from a path to the bytes there, gzipped or not. A data set that isn't in
    sets gets an error and no call.
    """
    rows = wanted.select("dataset", "download").distinct()
    if done is not None:
        rows = rows.join(done.select("dataset", "download"), ["dataset", "download"], "left_anti")
    rows = rows.join(sets.select("dataset", "path"), "dataset", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make()
        for frame in frames:
            for r in frame.itertuples(index=False):
                content, error = None, None
                try:
                    if not isinstance(r.path, str):
                        raise ValueError(f"{r.dataset} is not a valid dataset name")
                    content = get(f"{r.path}/{r.download}")
                    content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                except Exception as e:  # kept in the row
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"dataset": [r.dataset], "download": [r.download.removesuffix(".gz")], "content": [content], "error": [error]})

    return rows.repartition("dataset", "download").mapInPandas(run, "dataset string, download string, content binary, error string")


def compounds(keys: DataFrame, make, replay: DataFrame | None = None) -> DataFrame:
    """Name, smiles, inchikey (any may be null) with compound (cid, name, smiles, chembl_id, inchikey, synonyms, warning), error.

    A chain of calls, each once per distinct key: the identifier (inchikey before smiles before name), its properties, its
    synonyms, and the title of records without a name.
    """
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = keys.select("name", "smiles", "inchikey").distinct()
    kind = F.when(F.col("inchikey").isNotNull(), "inchikey").when(clean("smiles").isNotNull(), "smiles").when(clean("name").isNotNull(), "name")
    asked = F.concat(kind, F.lit("/"), dsl.quote(F.coalesce("inchikey", clean("smiles"), clean("name"))), F.lit("/cids/JSON"))
    call = lambda df, request, schema: fetch(df, request, schema, make, replay)
    rows = call(rows, asked, "IdentifierList struct<CID:array<long>>").withColumn("cid", F.get("r.IdentifierList.CID", F.lit(0)))
    rows = rows.withColumn("error", F.coalesce("error", F.when(kind.isNull(), "no key").when(F.col("cid").isNull(), "No result found in PubChem."))).drop("r")
    rows = cut(rows)
    of = lambda part: F.concat(F.lit("cid/"), F.col("cid").cast("string"), F.lit(f"/{part}/JSON"))
    found = rows.where("cid is not null").select("cid").distinct()
    info = call(found, of("property/ConnectivitySMILES,SMILES,InChIKey,IUPACName"), "PropertyTable struct<Properties:array<struct<ConnectivitySMILES:string,SMILES:string,InChIKey:string,IUPACName:string>>>")
    info = cut(info.select("cid", F.get("r.PropertyTable.Properties", F.lit(0)).alias("p"), F.col("error").alias("failed")))
    more = "InformationList struct<Information:array<struct<{}>>>"
    names = call(found, of("synonyms"), more.format("Synonym:array<string>")).select("cid", F.coalesce(F.get("r.InformationList.Information", F.lit(0))["Synonym"], F.array().cast("array<string>")).alias("synonyms"))
    titles = call(info.where("p.IUPACName is null").select("cid"), of("description"), more.format("Title:string")).select("cid", F.get("r.InformationList.Information", F.lit(0))["Title"].alias("title"))
    p = F.col("p")
    warning = F.when(p["SMILES"].isNull() | p["ConnectivitySMILES"].isNull(), "Record found but SMILES properties were unavailable.")
    compound = F.struct("cid", F.coalesce(p["IUPACName"], "title").alias("name"), p["SMILES"].alias("smiles"), dsl.first_with_prefix(F.col("synonyms"), "CHEMBL").alias("chembl_id"), p["InChIKey"].alias("inchikey"), "synonyms", warning.alias("warning"))
    whole = info.join(names, "cid").join(titles, "cid", "left").select("cid", F.when(p.isNotNull(), compound).alias("compound"), "failed")
    return rows.join(whole, "cid", "left").select("name", "smiles", "inchikey", "compound", F.coalesce("error", "failed").alias("error"))


def papers(queries: DataFrame, make, most: int = 30, at_once: int = 100) -> DataFrame:
    """Query, pos, paper: the first usable papers of each query, in order of relevance.

    A search gives ids in order; the details of all distinct ids are fetched some at a time, once each.
    """
    rows = fetch(queries.select("query").distinct(), F.concat(F.lit("search/"), dsl.quote(F.col("query"))), "ids array<string>", make)
    ids = cut(rows.select("query", F.posexplode("r.ids").alias("pos", "pmid")))
    distinct = ids.select("pmid").distinct()
    groups = max(1, -(-distinct.count() // at_once))
    asked = distinct.groupBy(F.pmod(F.xxhash64("pmid"), F.lit(groups)).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("pmid")), ",").alias("ids"))
    kind = f"papers array<struct<{PAPER.replace(' ', ':').replace(',:', ',')}>>"
    details = fetch(asked, F.concat(F.lit("fetch/"), F.col("ids")), kind, make).select(F.explode("r.papers").alias("paper"))
    details = details.where("paper.abstract is not null and paper.abstract <> 'Abstract not found'").select(F.col("paper.pmid").alias("pmid"), "paper").dropDuplicates(["pmid"])
    return resolve.first_n(ids.join(details, "pmid").select("query", "pos", "paper"), ["query"], most, F.col("pos"))


def nearest_papers(corpus: DataFrame, queries: DataFrame, most: int = 30) -> DataFrame:
    """S23 without a server: the index of papers (node_id, embedding, abstract) for any number of queries; filters come before the limit."""
    return cells.search(cells.build(corpus.where("abstract is not null and abstract <> 'Abstract not found'"), k=most), queries, most)


def encyclopedia(entities: DataFrame, make) -> DataFrame:
    """Index, info: the first document of each entity under its heading, in order of first appearance."""
    docs = fetch(entities.select("entity").distinct(), dsl.quote(F.col("entity")), "content string", make).where("error is null").select("entity", "r.content")
    first = entities.groupBy("index", "entity").agg(F.min("pos").alias("pos")).join(docs, "entity")
    parts = first.withColumn("part", F.concat(F.lit("## "), "entity", F.lit("\n"), "content"))
    return evidence.concat_in_order(parts, ["index"], "part", "pos", separator="\n", into="info")
