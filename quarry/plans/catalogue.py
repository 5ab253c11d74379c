"""Queries that run each operator on the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import ship, stored
from quarry.functions import dsl, metrics
from quarry.operators import cells, chains, evidence, graph, providers, resolve, retrieval, tagging, vectors
from quarry.sources import readers
from quarry.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


# ---- vectors --------------------------------------------------------------------------------------------------------

_TOPK = """
SELECT e.vec_id, round({score}, 6) AS score FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) t
ORDER BY {score} DESC, e.vec_id LIMIT 10"""
_SCORES = {
    "cosine": "list_cosine_similarity(e.embedding::DOUBLE[], t.q::DOUBLE[])",
    "l2": "1 / (1 + list_distance(e.embedding::DOUBLE[], t.q::DOUBLE[]))",
    "dot": "list_inner_product(e.embedding::DOUBLE[], t.q::DOUBLE[])",
}


def _topk(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    asked = t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.similar_each(t.embeddings, asked, 10, metric, key="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(_TOPK.format(score=_SCORES["cosine"]))
def vec_topk_cosine(spark, sf_dir):
    return _topk(spark, sf_dir, "cosine")


@query(_TOPK.format(score=_SCORES["l2"]))
def vec_topk_l2(spark, sf_dir):
    return _topk(spark, sf_dir, "l2")


@query(_TOPK.format(score=_SCORES["dot"]))
def vec_topk_dot(spark, sf_dir):
    return _topk(spark, sf_dir, "dot")


@query(f"""
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT e.label, e.vec_id, {_SCORES['cosine']} AS score, row_number() OVER (PARTITION BY e.label ORDER BY {_SCORES['cosine']} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) t) WHERE rank <= 3""")
def vec_topk_per_label(spark, sf_dir):
    rows = Tables(spark, sf_dir).embeddings
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    scored = rows.join(F.broadcast(asked), F.size("embedding") == F.size("q")).select("label", "vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("score"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", place.cast("long")).where("rank <= 3").withColumn("score", F.round("score", 6))


# ---- entity resolution and keyed joins --------------------------------------------------------------------------------

_MENTIONS = """
mentions AS (
  SELECT DISTINCT upper(p_name) AS entity, 'Chemical' AS tag FROM part
  UNION SELECT s_name, 'Disease' FROM supplier UNION SELECT c_name, 'Gene' FROM customer
  UNION SELECT lower(c_name), 'Gene' FROM customer UNION SELECT r_name, 'Disease' FROM region UNION SELECT upper(n_name), 'Disease' FROM nation
)"""
_CASCADE = f"""
WITH {_MENTIONS},
names AS (
  SELECT key, arg_max(node_id, node_id) AS node_id FROM (SELECT lower(p_name) AS key, 1000 + p_partkey AS node_id FROM part
  UNION ALL SELECT lower(n_name), 100 + n_nationkey FROM nation) GROUP BY key
), syn AS (SELECT s_name AS key, max(100 + s_nationkey) AS node_id FROM supplier GROUP BY s_name),
alias AS (SELECT c_name AS key, max(100 + c_nationkey) AS node_id FROM customer GROUP BY c_name),
hits AS (
  SELECT entity, tag, node_id, 1 AS priority FROM mentions JOIN names ON lower(entity) = key
  UNION ALL SELECT entity, tag, node_id, 2 FROM mentions JOIN syn ON entity = key WHERE tag = 'Disease'
  UNION ALL SELECT entity, tag, node_id, 3 FROM mentions JOIN alias ON entity = key WHERE tag = 'Gene'
), best AS (SELECT entity, tag, arg_min(node_id, priority) AS node_id, min(priority) AS priority FROM hits GROUP BY entity, tag)
"""


def _cascade(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = lambda df, c, tag: df.select(c.alias("entity"), F.lit(tag).alias("tag"))
    mentions = named(t.part, F.upper("p_name"), "Chemical")
    for rows in (named(t.supplier, F.col("s_name"), "Disease"), named(t.customer, F.col("c_name"), "Gene"), named(t.customer, F.lower("c_name"), "Gene"), named(t.region, F.col("r_name"), "Disease"), named(t.nation, F.upper("n_name"), "Disease")):
        mentions = mentions.unionByName(rows)
    nodes = t.part.select(F.col("p_name").alias("name"), (F.col("p_partkey") + 1000).alias("id")).unionByName(t.nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("id")))
    return resolve.resolve(mentions, [
        resolve.candidate(nodes, F.lower("name"), F.col("id"), 1),
        resolve.candidate(t.supplier, F.col("s_name"), F.col("s_nationkey") + 100, 2, "Disease", fold=False),
        resolve.candidate(t.customer, F.col("c_name"), F.col("c_nationkey") + 100, 3, "Gene", fold=False),
    ])


@query(_CASCADE + "SELECT entity, tag, CAST(node_id AS BIGINT) AS node_id, priority FROM best")
def entity_resolve_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).where("node_id is not null")


@query(_CASCADE + "SELECT entity, tag FROM mentions ANTI JOIN best USING (entity, tag)")
def entity_unmatched(spark, sf_dir):
    return resolve.unmatched(_cascade(spark, sf_dir))


_NAMED = """
nodes AS (SELECT 1000 + p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 100 + n_nationkey, n_name FROM nation),
folded AS (SELECT lower(name) AS key, max(id) AS id FROM nodes GROUP BY 1), named AS (SELECT name AS key, max(id) AS id FROM nodes GROUP BY 1)"""
_FIRST = "SELECT entity, CAST(coalesce(f.id, n.id, x.id, -1) AS BIGINT) AS node_id FROM mentions m LEFT JOIN folded f ON f.key = lower(entity) LEFT JOIN named n ON n.key = entity LEFT JOIN other x USING (entity)"


def _nodes(t: Tables) -> DataFrame:
    return t.part.select((F.col("p_partkey") + 1000).cast("long").alias("node_id"), F.col("p_name").alias("name")).unionByName(t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.col("n_name").alias("name")))


def _resolved(mentions: DataFrame, tag: str, nodes: DataFrame, more: list[DataFrame]) -> DataFrame:
    rows = mentions.distinct().withColumn("tag", F.lit(tag))
    return resolve.resolve(rows, [*chains.by_name(nodes), *more]).select("entity", F.coalesce("node_id", F.lit(-1).cast("long")).alias("node_id"))


# labels are regions and nations; synonyms are suppliers, and the regions, which are labels already but of no node
@query(f"""
WITH {_NAMED}, mentions AS (SELECT s_name AS entity FROM supplier UNION SELECT n_name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT r_name FROM region),
labels AS (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region),
syn AS (SELECT s_name AS synonym, max(n_name) AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, min(n_name) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
other AS (SELECT label AS entity, id FROM labels JOIN named ON key = label UNION ALL SELECT synonym, id FROM syn JOIN labels USING (label) JOIN named ON key = label WHERE synonym NOT IN (SELECT label FROM labels))
{_FIRST}""")
def cascade_disease(spark, sf_dir):
    t = Tables(spark, sf_dir)
    name = lambda c: F.col(c).alias("entity")
    mentions = t.supplier.select(name("s_name")).unionByName(t.nation.select(name("n_name"))).unionByName(t.nation.select(F.lower("n_name").alias("entity"))).unionByName(t.region.select(name("r_name")))
    labels = t.nation.select(F.col("n_name").alias("label")).unionByName(t.region.select(F.col("r_name").alias("label")))
    own = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("s_name").alias("synonym")).agg(F.max("n_name").alias("label"))
    odd = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("synonym")).agg(F.min("n_name").alias("label"))
    return _resolved(mentions, "Disease", _nodes(t), chains.for_diseases(labels, own.unionByName(odd), _nodes(t)))


# drugs are suppliers, named as parts; customers are known to the compound service alone
@query(f"""
WITH {_NAMED}, mentions AS (SELECT upper(s_name) AS entity FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part),
drugs AS (SELECT 'DB' || s_suppkey AS drug_id, p_name AS name FROM supplier JOIN part ON p_partkey = 2 * s_suppkey),
alias AS (SELECT lower(s_name) AS entity, min('DB' || s_suppkey) AS drug_id FROM supplier GROUP BY 1),
comp AS (SELECT lower(c_name) AS entity, min('DB' || c_nationkey) AS drug_id FROM customer GROUP BY 1),
ids AS (SELECT * FROM alias UNION ALL SELECT * FROM comp WHERE entity NOT IN (SELECT entity FROM alias)),
found AS (SELECT entity, max(id) AS id FROM ids JOIN drugs USING (drug_id) JOIN named ON key = name GROUP BY 1), other AS (SELECT m.entity, id FROM mentions m JOIN found f ON lower(m.entity) = f.entity)
{_FIRST}""")
def cascade_chemical(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mentions = t.supplier.select(F.upper("s_name").alias("entity")).unionByName(t.customer.select(F.col("c_name").alias("entity"))).unionByName(t.part.select(F.col("p_name").alias("entity")))
    drug = F.concat(F.lit("DB"), F.col("s_suppkey").cast("string"))
    aliases = t.supplier.groupBy(F.lower("s_name").alias("alias_lc")).agg(F.min(drug).alias("drug_id")).withColumn("priority", F.lit(1))
    drugs = t.supplier.join(t.part, F.col("p_partkey") == 2 * F.col("s_suppkey")).select(drug.alias("drug_id"), F.col("p_name").alias("name"))
    compounds = t.customer.select(F.col("c_name").alias("name"), F.array(F.lit("x"), F.concat(F.lit("DB"), F.col("c_nationkey").cast("string"))).alias("synonyms"))
    return _resolved(mentions, "Chemical", _nodes(t), chains.for_chemicals(aliases, drugs, _nodes(t), compounds))


@query(f"""
WITH {_NAMED}, mentions AS (SELECT s_name AS entity FROM supplier UNION SELECT lower(s_name) FROM supplier UNION SELECT n_name FROM nation),
other AS (SELECT s_name AS entity, arg_max(id, n_nationkey) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN named ON key = n_name WHERE n_regionkey < 3 GROUP BY 1)
{_FIRST}""")
def cascade_gene(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mentions = t.supplier.select(F.col("s_name").alias("entity")).unionByName(t.supplier.select(F.lower("s_name").alias("entity"))).unionByName(t.nation.select(F.col("n_name").alias("entity")))
    listed = t.supplier.groupBy("s_nationkey").agg(F.collect_set("s_name").alias("aliases"))
    info = t.nation.join(listed, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, "gene/protein").otherwise("drug").alias("type"), "aliases")
    return _resolved(mentions, "Gene", _nodes(t), chains.for_genes(chains.gene_aliases(info, _nodes(t))))


def _lengths():
    """A stand-in encoder: the length of a text and one."""
    return lambda texts: [[float(len(x)), 1.0] for x in texts]


# each region's record names its nations and, unknown to the graph, itself, which brings the nearest nation
@query("""
WITH mentions AS (SELECT r_regionkey AS index, upper(n_name) AS entity FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT r_regionkey, 'Region ' || r_name || repeat('x', CAST(r_regionkey AS INT)) FROM region),
known AS (SELECT index, 100 + n_nationkey AS node_id FROM mentions JOIN nation ON lower(n_name) = lower(entity)),
lost AS (SELECT index, entity FROM mentions WHERE lower(entity) NOT IN (SELECT lower(n_name) FROM nation)),
near AS (SELECT index, node_id FROM (SELECT index, 100 + n_nationkey AS node_id, row_number() OVER (PARTITION BY index, entity ORDER BY list_cosine_similarity([length(entity)::DOUBLE, 1.0::DOUBLE], [(100 + n_nationkey)::DOUBLE / 4, 1.0::DOUBLE]) DESC, n_nationkey) AS r FROM lost, nation) WHERE r = 1),
every AS (SELECT * FROM known UNION SELECT * FROM near)
SELECT index, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS node_list, string_agg('doc ' || node_id || chr(10) || chr(10), '' ORDER BY node_id) AS info FROM every GROUP BY index""")
def kg_info(spark, sf_dir):
    ship(spark)
    t = Tables(spark, sf_dir)
    own = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("index"), F.upper("n_name").alias("entity"))
    lost = t.region.select(F.col("r_regionkey").alias("index"), F.concat(F.lit("Region "), "r_name", F.repeat(F.lit("x"), F.col("r_regionkey").cast("int"))).alias("entity"))
    node = (F.col("n_nationkey") + 100).cast("long")
    nodes = t.nation.select(node.alias("node_id"), F.col("n_name").alias("name"), F.array((node / 4).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    docs = nodes.select("node_id", F.concat(F.lit("doc "), F.col("node_id").cast("string")).alias("doc"))
    found = chains.kg_info(own.unionByName(lost).withColumn("tag", F.lit("Other")), chains.by_name(nodes), nodes, _lengths, docs)
    return found.select("index", F.array_join("node_list", ",").alias("node_list"), "info")


@query("""
WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS entity, event_type AS tag, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS side, event_id FROM events)
SELECT user_id, entity, arg_max(tag, side * 1000000000 + event_id) AS tag FROM e GROUP BY user_id, entity""")
def map_merge_last_wins(spark, sf_dir):
    entries = Tables(spark, sf_dir).events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("entity"), F.col("event_type").alias("tag"), "event_id")
    first = entries.where("tag = 'view'")
    return resolve.merge_maps(first, entries.where("tag <> 'view'"), ["user_id", "entity"], "tag", "event_id")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.remaining(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("SELECT d.doc_id, d.lang AS lang_gt, l.quality AS quality_gen FROM documents d JOIN labels l USING (doc_id)")
def eval_keyed_align(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.align(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'gt' ELSE 'gen' END AS only_in FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def eval_mismatches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.misaligned(t.documents, t.labels, "doc_id")


@query("""
WITH w AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT p_partkey, 0 FROM part),
e AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_orderkey * 10 + l_linenumber) AS edge_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT w.src, w.dst, coalesce(edge_id, -1) AS edge_id, coalesce(n, 0) AS n FROM w LEFT JOIN e USING (src, dst)""")
def edge_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"))
    wanted = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).unionByName(t.part.select(F.col("p_partkey").alias("src"), F.lit(0).cast("long").alias("dst")))
    return resolve.edge_ids(edges, wanted)


@query("SELECT n_name, string_agg(s_name, chr(10) ORDER BY s_suppkey) AS doc FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def node_docs_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return evidence.concat_in_order(rows, ["n_name"], "s_name", "s_suppkey", separator="\n", into="doc")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.withColumn("line", F.concat("role", F.lit(": "), "text"))
    return evidence.concat_in_order(rows, ["conv_id"], "line", "turn", separator="\n")


# ---- graph ------------------------------------------------------------------------------------------------------------

_EDGES = """
edges AS (
  SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst FROM nation
  UNION ALL SELECT 100 + c_nationkey, 1000000 + c_custkey FROM customer
  UNION ALL SELECT 100 + s_nationkey, 2000000 + s_suppkey FROM supplier
), both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def _edges(t: Tables) -> DataFrame:
    pair = lambda df, a, b: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"))
    return pair(t.nation, F.col("n_regionkey"), F.col("n_nationkey") + 100).unionByName(pair(t.customer, F.col("c_nationkey") + 100, F.col("c_custkey") + 1000000)).unionByName(pair(t.supplier, F.col("s_nationkey") + 100, F.col("s_suppkey") + 2000000))


@query(f"WITH {_EDGES} SELECT src AS node_id, count(*) AS degree FROM both_ways GROUP BY src")
def graph_undirected_degree(spark, sf_dir):
    return graph.degree(_edges(Tables(spark, sf_dir)))


_HOPS = f"""
WITH RECURSIVE {_EDGES}, walk AS (
  SELECT CAST(0 AS BIGINT) AS node_id, 0 AS dist UNION SELECT b.dst, w.dist + 1 FROM walk w JOIN both_ways b ON b.src = w.node_id WHERE w.dist < {{k}}
) SELECT node_id, min(dist) AS dist FROM walk GROUP BY node_id"""


def _hops(spark, sf_dir, k):
    return graph.distances(_edges(Tables(spark, sf_dir)), spark.range(1).withColumnRenamed("id", "node_id"), k)


@query(_HOPS.format(k=1))
def graph_k_hop_1(spark, sf_dir):
    return _hops(spark, sf_dir, 1)


@query(_HOPS.format(k=2))
def graph_k_hop_2(spark, sf_dir):
    return _hops(spark, sf_dir, 2)


@query(f"""
WITH RECURSIVE {_EDGES}, walk AS (
  SELECT CAST(100 + n_nationkey AS BIGINT) AS source, CAST(100 + n_nationkey AS BIGINT) AS node_id, 0 AS dist FROM nation
  UNION SELECT w.source, b.dst, w.dist + 1 FROM walk w JOIN both_ways b ON b.src = w.node_id WHERE w.dist < 3
) SELECT source, node_id, min(dist) AS dist FROM walk GROUP BY source, node_id""")
def graph_shortest_path_len(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sources = t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("node_id"))
    return graph.distances(_edges(t), sources, 3, each=True)


@query("""
SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""")
def induced_subgraph(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))
    keep = t.part.where("p_size < 10").select(F.col("p_partkey").alias("node_id")).unionByName(t.supplier.where("s_acctbal > 0").select((-F.col("s_suppkey") - 1).alias("node_id")))
    return graph.induced(edges, keep).groupBy("src", (-F.col("dst") - 1).alias("dst")).agg(F.count("*").alias("n"))


_TERMINALS = [0, 100, 105, 1000001, 2000001]


@query(f"""
WITH RECURSIVE {_EDGES}, walk AS (
  SELECT CAST(t AS BIGINT) AS source, CAST(t AS BIGINT) AS node_id, [CAST(t AS BIGINT)] AS path FROM (SELECT unnest({_TERMINALS}) AS t)
  UNION ALL SELECT source, b.dst, list_append(path, b.dst) FROM walk w JOIN both_ways b ON b.src = w.node_id WHERE len(path) < 7 AND NOT list_contains(path, b.dst)
), on_paths AS (SELECT DISTINCT unnest(path) AS id FROM walk WHERE list_contains({_TERMINALS}, node_id) AND len(path) > 1)
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM on_paths) AND dst IN (SELECT id FROM on_paths)""")
def graph_steiner_edges(spark, sf_dir):
    return graph.connecting_subgraph(_edges(Tables(spark, sf_dir)), _TERMINALS)


@query(f"""
WITH {_EDGES}, picked AS (SELECT src, dst, pos FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM edges) WHERE pos < 500),
ends AS (SELECT src AS id FROM picked UNION SELECT dst FROM picked)
SELECT 'The retrieved subgraph contains ' || (SELECT count(*) FROM ends) || ' nodes and ' || (SELECT count(*) FROM picked) || ' edges.' || chr(10) || chr(10) || 'Nodes:' || chr(10)
  || (SELECT string_agg('- Node ID: ' || id || ', Doc Info: doc ' || id, chr(10) ORDER BY id) FROM ends) || chr(10) || chr(10) || 'Connections:' || chr(10)
  || (SELECT string_agg('- Node ID ' || src || ' is connected to Node ID ' || dst || ' with edge type: has', chr(10) ORDER BY pos) FROM picked) AS text""")
def subgraph_text(spark, sf_dir):
    edges = _edges(Tables(spark, sf_dir)).withColumns({"pos": F.struct("src", "dst"), "type_id": F.lit(1)})
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("doc", F.concat(F.lit("doc "), F.col("node_id").cast("string")))
    return evidence.subgraph_text(edges, nodes, spark.range(1, 2).select(F.col("id").cast("int").alias("type_id"), F.lit("has").alias("label")))


# a supplier's record names it, a customer and a nation; all hang on one root, so the connecting set is the tree up to the deepest node above all
@query(r"""
WITH RECURSIVE edges AS (
  SELECT CAST(-1 AS BIGINT) AS src, CAST(r_regionkey AS BIGINT) AS dst FROM region UNION ALL SELECT n_regionkey, 100 + n_nationkey FROM nation
  UNION ALL SELECT 100 + c_nationkey, 1000000 + c_custkey FROM customer UNION ALL SELECT 100 + s_nationkey, 2000000 + s_suppkey FROM supplier
), terminals AS (
  SELECT s_suppkey AS index, 2000000 + s_suppkey AS node_id FROM supplier UNION SELECT c_custkey // 10, 1000000 + c_custkey FROM customer WHERE c_custkey % 10 = 0 AND c_custkey // 10 IN (SELECT s_suppkey FROM supplier)
  UNION SELECT s_suppkey, 100 + s_suppkey % 25 FROM supplier
), walk AS (
  SELECT index, node_id AS terminal, node_id, 0 AS up FROM terminals UNION ALL SELECT w.index, w.terminal, e.src, w.up + 1 FROM walk w JOIN edges e ON e.dst = w.node_id
), above AS (SELECT index, node_id, count(*) AS n, max(up) AS up FROM walk GROUP BY ALL
), lowest AS (SELECT a.index, min(a.up) AS up FROM above a WHERE a.n = (SELECT count(*) FROM terminals t WHERE t.index = a.index) GROUP BY a.index
), keep AS (SELECT a.index, a.node_id FROM above a JOIN lowest l USING (index) WHERE a.up <= l.up
), found AS (
  SELECT k.index, e.src, e.dst, row_number() OVER (PARTITION BY k.index ORDER BY e.dst) AS pos FROM keep k JOIN edges e ON e.dst = k.node_id JOIN keep o ON o.index = k.index AND o.node_id = e.src
), ends AS (SELECT index, src AS id FROM found UNION SELECT index, dst FROM found
), nodes AS (SELECT index, count(*) AS n, string_agg('- Node ID: ' || id || ', Doc Info: doc ' || id, chr(10) ORDER BY id) AS lines FROM ends GROUP BY index
), links AS (
  SELECT index, count(*) AS m, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS subgraph,
    string_agg('- Node ID ' || src || ' is connected to Node ID ' || dst || ' with edge type: ' || CASE WHEN dst >= 1000000 THEN 'has' ELSE 'holds' END, chr(10) ORDER BY dst) AS lines FROM found GROUP BY index
), listed AS (SELECT index, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS node_list FROM terminals GROUP BY index)
SELECT index, node_list, subgraph, 'The retrieved subgraph contains ' || n || ' nodes and ' || m || ' edges.' || chr(10) || chr(10) || 'Nodes:' || chr(10) || nodes.lines || chr(10) || chr(10) || 'Connections:' || chr(10) || links.lines AS info
FROM listed JOIN nodes USING (index) JOIN links USING (index)""")
def kg_subgraph_info(spark, sf_dir):
    t = Tables(spark, sf_dir)
    root = t.region.select(F.lit(-1).cast("long").alias("src"), F.col("r_regionkey").cast("long").alias("dst"))
    edges = _edges(t).unionByName(root).select(F.col("dst").alias("edge_id"), "src", "dst", F.when(F.col("dst") >= 1000000, 1).otherwise(2).alias("type_id"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("index"), (F.col("s_suppkey") + 2000000).alias("node_id"))
    customers = t.customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") / 10).cast("long").alias("index"), (F.col("c_custkey") + 1000000).alias("node_id")).join(suppliers.select("index"), "index", "left_semi")
    nations = t.supplier.select(F.col("s_suppkey").alias("index"), (F.col("s_suppkey") % 25 + 100).alias("node_id"))
    docs = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("doc", F.concat(F.lit("doc "), F.col("node_id").cast("string")))
    types = spark.createDataFrame([(1, "has"), (2, "holds")], "type_id int, label string")
    found = chains.kg_subgraph_info(suppliers.unionByName(customers).unionByName(nations), edges, docs, types)
    return found.select("index", F.array_join("node_list", ",").alias("node_list"), F.array_join(F.transform("subgraph", lambda e: e.cast("string")), ",").alias("subgraph"), "info")


_SMALL = """
links AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS src, l_partkey % 5 AS dst FROM lineitem),
reach AS (SELECT l_orderkey, src, dst FROM links UNION SELECT r.l_orderkey, r.src, e.dst FROM reach r JOIN links e ON e.l_orderkey = r.l_orderkey AND e.src = r.dst)"""


def _small(spark, sf_dir) -> DataFrame:
    """A graph of five nodes an order."""
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", (F.col("l_suppkey") % 5).alias("src"), (F.col("l_partkey") % 5).alias("dst"))


@query(f"WITH RECURSIVE {_SMALL} SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE src = dst) > 0 THEN 0 ELSE 1 END AS dag FROM reach GROUP BY l_orderkey")
def graphs_acyclic(spark, sf_dir):
    return graph.acyclic(_small(spark, sf_dir), ["l_orderkey"])


# ---- explanation language -----------------------------------------------------------------------------------------------

_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'correlative' ELSE 'causal' END AS relation,
    'edge("n' || l_linenumber || '", "n' || (l_linenumber + 1) || '", relation="' || CASE WHEN l_returnflag = 'R' THEN 'correlative' ELSE 'causal' END || '")' AS edge,
    CASE WHEN l_linestatus = 'O' THEN 'binds_to' ELSE 'made_up' END || '(id="n' || l_linenumber || '", actor="s' || l_suppkey || '")' AS line
  FROM lineitem
), texts AS (
  SELECT l_orderkey, string_agg(edge, chr(10) ORDER BY l_linenumber, edge) AS dag, 'set_context(id="n0")' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS explain
  FROM lines GROUP BY l_orderkey
)"""


def _texts(t: Tables) -> DataFrame:
    n, m = F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 1).cast("string")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit('edge("n'), n, F.lit('", "n'), m, F.lit('", relation="'), F.when(F.col("l_returnflag") == "R", "correlative").otherwise("causal"), F.lit('")')).alias("edge"), F.concat(F.when(F.col("l_linestatus") == "O", "binds_to").otherwise("made_up"), F.lit('(id="n'), n, F.lit('", actor="s'), F.col("l_suppkey").cast("string"), F.lit('")')).alias("line"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", c))), lambda r: r[c]), "\n")
    return rows.groupBy("l_orderkey").agg(joined("edge").alias("dag"), F.concat(F.lit('set_context(id="n0")\n'), joined("line")).alias("explain"))


@query(f"WITH {_LINES}, p AS (SELECT l_orderkey, unnest(regexp_extract_all(explain, '(?m)^[ \\t]*([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS primitive FROM texts) SELECT l_orderkey, primitive, count(*) AS n FROM p GROUP BY ALL")
def dsl_primitives(spark, sf_dir):
    return _texts(Tables(spark, sf_dir)).select("l_orderkey", F.explode(dsl.primitives(F.col("explain"))).alias("primitive")).groupBy("l_orderkey", "primitive").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT l_orderkey, 'n' || l_linenumber AS src, 'n' || (l_linenumber + 1) AS tgt, max(relation) AS relation FROM lines WHERE l_linenumber <> 2 AND l_linenumber <> 3 AND l_linenumber <> 4 GROUP BY l_orderkey, l_linenumber")
def dsl_edges(spark, sf_dir):
    # lines 2 to 4 are almost edges: single quotes, a blank too many, blanks around the equals sign
    odd = F.regexp_replace(F.regexp_replace(F.regexp_replace("dag", 'edge\\("n2", "n3"', "edge('n2', 'n3'"), 'edge\\("n3"', 'edge( "n3"'), '"n4", "n5", relation=', '"n4", "n5", relation = ')
    rows = _texts(Tables(spark, sf_dir)).select("l_orderkey", F.explode(dsl.edges(odd)).alias("e"))
    return rows.select("l_orderkey", "e.src", "e.tgt", "e.relation")


@query(f"WITH {_LINES}, i AS (SELECT l_orderkey, unnest(regexp_extract_all(explain, 'id\\s*=\\s*\"(n\\d+)\"', 1)) AS id FROM texts) SELECT l_orderkey, id, count(*) AS n FROM i GROUP BY ALL")
def dsl_ids(spark, sf_dir):
    return _texts(Tables(spark, sf_dir)).select("l_orderkey", F.explode(dsl.defined_ids(F.col("explain"))).alias("id")).groupBy("l_orderkey", "id").agg(F.count("*").alias("n"))


@query(f"""
WITH {_LINES}, p AS (SELECT l_orderkey, explain, dag, string_split(explain, chr(10))[2:] AS rest, regexp_extract_all(explain, '"(n[1-9]\\d*)"', 1) AS ids, regexp_extract_all(dag, '\\b(n\\d+)\\b', 1) AS used FROM texts)
SELECT l_orderkey, CAST(len(ids) = len(rest) AND len([x FOR x IN used IF NOT list_contains(ids, x)]) = 0 AS INT) AS coherent FROM p""")
def id_coherence(spark, sf_dir):
    return _texts(Tables(spark, sf_dir)).select("l_orderkey", metrics.id_coherence(F.col("explain"), F.col("dag")).alias("coherent"))


@query(f"""
WITH RECURSIVE {_LINES}, arcs AS (
  SELECT DISTINCT l_orderkey, l_linenumber AS a, l_linenumber + 1 AS b FROM lines
  UNION SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 4 ELSE 1 END, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 4 END FROM texts
), reach AS (SELECT l_orderkey, a, b FROM arcs UNION SELECT r.l_orderkey, r.a, x.b FROM reach r JOIN arcs x ON x.l_orderkey = r.l_orderkey AND x.a = r.b)
SELECT l_orderkey, 1 - max(CAST(a = b AS INT)) AS acyclic FROM reach GROUP BY l_orderkey""")
def dag_acyclic(spark, sf_dir):
    # a third of the graphs get an edge back, which closes a cycle where lines 2 and 3 are there; the others one ahead
    more = F.when(F.col("l_orderkey") % 3 == 0, '\nedge("n4", "n2", relation="causal")').otherwise('\nedge("n1", "n4", relation="causal")')
    rows = _texts(Tables(spark, sf_dir)).select("l_orderkey", dsl.edges(F.concat("dag", more)).alias("edges"))
    return rows.select("l_orderkey", metrics.acyclic(F.col("edges")).alias("acyclic"))


@query(f"WITH {_LINES} SELECT l_orderkey, round(1.0::DOUBLE * sum(CASE WHEN l.line LIKE 'binds_to%' THEN 1 ELSE 0 END) / (count(*) + 1) + 1.0::DOUBLE / (count(*) + 1), 6) AS validity FROM lines l GROUP BY l_orderkey")
def primitive_validity(spark, sf_dir):
    words = F.array(F.lit("set_context"), F.lit("binds_to"))
    return _texts(Tables(spark, sf_dir)).select("l_orderkey", F.round(metrics.validity(F.col("explain"), words), 6).alias("validity"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' ' || chr(9) || chr(10) || chr(13)) AS title, CAST(regexp_matches(html, '(?s)<title>.*?</title>') AS INT) AS strict FROM pages")
def dsl_sections(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", dsl.section(F.col("html"), "title").alias("title"), dsl.strict_section(F.col("html"), "title").isNotNull().cast("int").alias("strict"))


_REPLY = "'<think>' || html || '</think><answer>' || CASE WHEN page_id % 2 = 0 THEN 'yes</answer>' ELSE 'no' END || '<explain></explain><dag></dag>'"


@query(f"SELECT page_id, CAST(regexp_matches(r, '(?s)<think>.*?</think>') AND regexp_matches(r, '(?s)<answer>.*?</answer>') AND regexp_matches(r, '(?s)<explain>.*?</explain>') AND regexp_matches(r, '(?s)<dag>.*?</dag>') AS INT) AS valid FROM (SELECT page_id, {_REPLY} AS r FROM pages)")
def schema_validity(spark, sf_dir):
    reply = F.concat(F.lit("<think>"), "html", F.lit("</think><answer>"), F.when(F.col("page_id") % 2 == 0, "yes</answer>").otherwise("no"), F.lit("<explain></explain><dag></dag>"))
    return Tables(spark, sf_dir).pages.select("page_id", metrics.schema_validity(reply).alias("valid"))


@query("""
WITH c AS (SELECT user_id, event_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS gt, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS gen FROM events GROUP BY ALL),
s AS (SELECT user_id, sum(least(gt, gen))::DOUBLE AS tp, sum(gt)::DOUBLE AS g, sum(gen)::DOUBLE AS h FROM c GROUP BY user_id),
r AS (SELECT user_id, coalesce(tp / nullif(h, 0), 0) AS p, coalesce(tp / nullif(g, 0), 0) AS r FROM s)
SELECT user_id, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r""")
def primitive_multiset_f1(spark, sf_dir):
    half = lambda k: F.collect_list(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    rows = Tables(spark, sf_dir).events.groupBy("user_id").agg(half(0).alias("gt"), half(1).alias("gen"))
    return rows.select("user_id", metrics.multiset_f1(F.col("gt"), F.col("gen")).alias("s")).select("user_id", "s.*")


@query(f"""
WITH {_LINES}, a AS (SELECT DISTINCT l_orderkey, l_linenumber, max(relation) OVER (PARTITION BY l_orderkey, l_linenumber) AS relation FROM lines),
s AS (SELECT x.l_orderkey, count(*)::DOUBLE AS g FROM a x GROUP BY 1),
m AS (SELECT x.l_orderkey, count(y.l_orderkey)::DOUBLE AS tp FROM a x LEFT JOIN a y ON y.l_orderkey = x.l_orderkey + 1 AND y.l_linenumber = x.l_linenumber AND y.relation = x.relation GROUP BY 1),
r AS (SELECT l_orderkey, coalesce(tp / nullif(h.g, 0), 0) AS p, tp / s.g AS r FROM m JOIN s USING (l_orderkey) JOIN (SELECT l_orderkey - 1 AS l_orderkey, g FROM s) h USING (l_orderkey))
SELECT l_orderkey, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r""")
def edge_set_f1(spark, sf_dir):
    graphs = _texts(Tables(spark, sf_dir)).select("l_orderkey", dsl.edges(F.col("dag")).alias("edges"))
    after = graphs.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("edges").alias("other"))
    return graphs.join(after, "l_orderkey").select("l_orderkey", metrics.edge_f1(F.col("edges"), F.col("other"))["f1"].alias("f1"))


# ---- text metrics -------------------------------------------------------------------------------------------------------


def _pairs(t: Tables) -> DataFrame:
    return t.benchmark.join(t.documents.select("doc_id", F.col("text").alias("found")), F.col("item_id") == F.col("doc_id")).select("item_id", "text", "found")


@query("""
WITH g AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM benchmark), a AS (SELECT item_id, w, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM documents), b AS (SELECT item_id, w, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT item_id, sum(least(a.n, b.n))::DOUBLE AS tp FROM a JOIN b USING (item_id, w) GROUP BY 1),
s AS (SELECT i.item_id, coalesce(tp, 0) AS tp, len(regexp_extract_all(lower(i.text), '([a-z0-9]+)', 1)) AS x, len(regexp_extract_all(lower(d.text), '([a-z0-9]+)', 1)) AS y FROM benchmark i JOIN documents d ON d.doc_id = i.item_id LEFT JOIN t USING (item_id)),
r AS (SELECT item_id, coalesce(tp / nullif(y, 0), 0) AS p, coalesce(tp / nullif(x, 0), 0) AS r FROM s)
SELECT item_id, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r""")
def token_unigram_f1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    grams = lambda df, key, text, n: df.select(F.col(key).alias("item_id"), F.explode(metrics.tokens(F.col(text))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias(n))
    pairs = _pairs(t)  # only documents that are asked for are taken apart
    both = grams(pairs, "item_id", "text", "a").join(grams(pairs, "item_id", "found", "b"), ["item_id", "w"])
    tp = both.groupBy("item_id").agg(F.sum(F.least("a", "b")).alias("tp"))
    rows = pairs.join(tp, "item_id", "left").select("item_id", F.coalesce("tp", F.lit(0)).alias("tp"), F.size(metrics.tokens(F.col("text"))).alias("x"), F.size(metrics.tokens(F.col("found"))).alias("y"))
    return rows.select("item_id", metrics.f1(F.col("tp"), F.col("y") - F.col("tp"), F.col("x") - F.col("tp"))["f1"].alias("f1"))


@query("""
WITH p AS (SELECT item_id, regexp_extract_all(lower(b.text), '([a-z0-9]+)', 1) AS a, regexp_extract_all(lower(d.text), '([a-z0-9]+)', 1) AS f FROM benchmark b JOIN documents d ON doc_id = item_id),
x AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest([a[i] || ' ' || a[i + 1] FOR i IN range(1, len(a))]) AS g FROM p) GROUP BY ALL),
y AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest([f[i] || ' ' || f[i + 1] FOR i IN range(1, len(f))]) AS g FROM p) GROUP BY ALL),
t AS (SELECT item_id, sum(least(x.n, y.n))::DOUBLE AS tp FROM x JOIN y USING (item_id, g) GROUP BY 1)
SELECT item_id, round(coalesce(2 * tp / nullif(greatest(len(a) - 1, 0) + greatest(len(f) - 1, 0), 0), 0), 4) AS f1 FROM p LEFT JOIN t USING (item_id)""")
def token_rouge2(spark, sf_dir):
    return _pairs(Tables(spark, sf_dir)).select("item_id", F.round(metrics.rouge_n(F.col("text"), F.col("found"), 2), 4).alias("f1"))


@query()
def token_rougeL(spark, sf_dir):  # noqa: N802
    ship(spark)
    return _pairs(Tables(spark, sf_dir)).select("item_id", F.round(metrics.rouge_l(F.col("text"), F.col("found")), 4).alias("f1"))


def _bleu_sql(pairs: str) -> str:
    """BLEU by plain SQL: key, a (truth) and f (found) of pairs."""
    text = "replace(replace(replace(replace(replace(replace(replace(coalesce({c}, ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', chr(34)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    for rule, to in metrics.RULES:
        text = f"regexp_replace({text if 'regexp' in text else f"' ' || {text} || ' '"}, '{rule}', '{to.replace('$', chr(92))}', 'g')"
    cut = "list_filter(string_split_regex(" + text + ", '\\s+'), lambda x: x <> '')"
    grams = lambda side: " UNION ALL ".join(f"SELECT key, {n} AS n, unnest([array_to_string({side}[i:i + {n - 1}], ' ') FOR i IN range(1, len({side}) - {n - 2})]) AS g FROM w" for n in range(1, 5))
    return f"""
WITH p AS ({pairs}), w AS (SELECT key, {cut.format(c='a')} AS a, {cut.format(c='f')} AS f FROM p),
x AS (SELECT key, n, g, count(*) AS k FROM ({grams('a')}) GROUP BY ALL), y AS (SELECT key, n, g, count(*) AS k FROM ({grams('f')}) GROUP BY ALL),
c AS (SELECT y.key, y.n, sum(CASE WHEN x.k IS NULL THEN 0 ELSE least(x.k, y.k) END)::DOUBLE AS hits, sum(y.k)::DOUBLE AS total FROM y LEFT JOIN x ON x.key = y.key AND x.n = y.n AND x.g = y.g GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS misses, sum(hits) OVER (PARTITION BY key) AS any_hit FROM c),
s AS (SELECT key, max(any_hit) AS any_hit, avg(ln(CASE WHEN hits > 0 THEN hits / total ELSE 1 / (pow(2, misses) * total) END)) AS mean FROM m GROUP BY key)
SELECT w.key AS {{key}}, round(CASE WHEN coalesce(any_hit, 0) = 0 THEN 0 ELSE exp(mean) * CASE WHEN len(f) >= len(a) THEN 1 ELSE exp(1 - len(a) / len(f)) END END, 4) AS bleu FROM w LEFT JOIN s USING (key)"""


@query(_bleu_sql("SELECT item_id AS key, b.text AS a, d.text AS f FROM benchmark b JOIN documents d ON doc_id = item_id").format(key="item_id"))
def token_bleu(spark, sf_dir):
    return metrics.bleu_table(_pairs(Tables(spark, sf_dir)), ["item_id"], "text", "found").select("item_id", F.round("bleu", 4).alias("bleu"))


# every document against the one of the next id
@query(_bleu_sql("SELECT d.doc_id AS key, d.text AS a, n.text AS f FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1").format(key="doc_id"))
def document_bleu(spark, sf_dir):
    docs = stored(Tables(spark, sf_dir).documents.select("doc_id", metrics.lines_13a(F.col("text")).alias("truth")))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("truth").alias("found")), "doc_id")
    return metrics.bleu_of_lines(pairs, ["doc_id"], "truth", "found").select("doc_id", F.round("bleu", 4).alias("bleu"))


@query()
def token_scores(spark, sf_dir):
    ship(spark)
    return metrics.token_scores(_pairs(Tables(spark, sf_dir)), "item_id", "text", "found", "paragraph")


@query("""
SELECT 'quality' AS metric, round(avg(quality), 4) AS value FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 4) FROM labels UNION ALL
SELECT 'size/n_chars', round(avg(n_chars), 4) FROM documents JOIN labels USING (doc_id)""")
def metric_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.means(t.labels.join(t.documents.select("doc_id", F.struct("n_chars").alias("size")), "doc_id"), skip=("doc_id",))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS k, 0.0::DOUBLE AS missing FROM events")
def judge_json_scores(spark, sf_dir):
    reply = F.concat(F.lit("My scores: "), F.col("props"), F.lit(" as asked."))
    return Tables(spark, sf_dir).events.select("event_id", dsl.judge_scores(reply, ["k", "missing"]).alias("s")).select("event_id", "s.*")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1.0::DOUBLE WHEN role = 'assistant' THEN 0.0::DOUBLE END AS correct FROM conversations")
def judge_binary(spark, sf_dir):
    reply = F.concat("text", F.when(F.col("role") == "user", "<answer>YES</answer>").when(F.col("role") == "assistant", "<answer> yes</answer>").otherwise(""))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", metrics.correctness(reply).alias("correct"))


# ---- records, order, dedupe -----------------------------------------------------------------------------------------------

_DEDUPE = "SELECT {agg}(doc_id) AS doc_id FROM documents GROUP BY text, lang"


@query(_DEDUPE.format(agg="min"))
def dedupe_ignoring_index_first(spark, sf_dir):
    return resolve.dedupe(Tables(spark, sf_dir).documents.select("doc_id", "text", "lang"), "doc_id").select("doc_id")


@query(_DEDUPE.format(agg="max"))
def dedupe_ignoring_index_last(spark, sf_dir):
    return resolve.dedupe(Tables(spark, sf_dir).documents.select("doc_id", "text", "lang"), "doc_id", "last").select("doc_id")


@query("SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT), c_name) - 1 AS pos FROM customer")
def natural_sort(spark, sf_dir):
    return resolve.positions(Tables(spark, sf_dir).customer.select("c_name"), "pos", dsl.natural_key(F.col("c_name")), F.col("c_name"))


@query("SELECT 'tahoe_' || o_orderkey AS idx FROM orders ORDER BY 1 LIMIT 20")
def string_sort_limit(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(F.concat(F.lit("tahoe_"), F.col("o_orderkey").cast("string")).alias("idx")).orderBy("idx").limit(20)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> 'en') WHERE r <= 3")
def filter_sentinel_topn(spark, sf_dir):
    abstract = F.when(F.coalesce("lang", F.lit("")) == "en", "Abstract not found").otherwise(F.col("text"))
    papers = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("pmid"), "source", "n_chars", abstract.alias("abstract"))
    rows = readers.usable_papers(papers).select("source", F.col("pmid").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"))
    return resolve.first_n(rows, ["source"], 3, F.col("n_chars").desc(), F.col("doc_id")).select("source", "doc_id")


@query("SELECT p_partkey, [s FOR s IN [p_brand, p_name, p_type] IF NOT regexp_matches(s, '\\d')][1] AS plain, [s FOR s IN [p_name, p_brand] IF starts_with(s, 'Brand')][1] AS brand FROM part")
def digit_free_first_synonym(spark, sf_dir):
    names = F.array("p_brand", "p_name", "p_type")
    return Tables(spark, sf_dir).part.select("p_partkey", dsl.first_without_digit(names).alias("plain"), dsl.first_with_prefix(F.array("p_name", "p_brand"), "Brand").alias("brand"))


@query("SELECT doc_id, n - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE line <> ''")
def text_to_records(spark, sf_dir):
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where("line <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


_TEMPLATE = "Report on {treatment}.\n### EXPECTED OUTPUT\nText."


@query("""SELECT conv_id, turn, md5('Report on ' || text || '.' || chr(10) || chr(10) || '# ADDITIONAL INFORMATION' || chr(10) || role || chr(10) || 'Please use the additional information to generate the report.### EXPECTED OUTPUT' || chr(10) || 'Text.') AS key FROM conversations""")
def prompt_build(spark, sf_dir):
    prompt = evidence.report_prompt(_TEMPLATE, F.col("text"), F.col("role"))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", dsl.prompt_key(prompt).alias("key"))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def prompt_dedupe_join_back(spark, sf_dir):
    ship(spark)
    rows = Tables(spark, sf_dir).conversations
    replies = providers.call_once(rows, "text", lambda: lambda texts: [str(len(t)) for t in texts])
    return providers.join_back(rows, "text", replies).select("conv_id", "turn", F.col("reply").cast("long").alias("n"))


@query("""
WITH h AS (SELECT doc_id, CASE WHEN NOT contains(text, 'the') THEN NULL WHEN NOT contains(text, 'that') THEN 2 WHEN NOT contains(text, 'worthless') THEN 1 ELSE 0 END AS round FROM documents),
n AS (SELECT count(*) FILTER (WHERE round = 0) AS a, count(*) FILTER (WHERE round <= 1) AS b FROM h)
SELECT doc_id, round FROM h, n WHERE round = 0 OR round = 1 AND a < 100 OR round = 2 AND b < 100 ORDER BY round, doc_id LIMIT 100""")
def query_relaxation(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")

    def search(words: str) -> DataFrame:
        hits = docs
        for word in words.split(","):
            hits = hits.where(F.contains("text", F.lit(word)))
        return hits.select("doc_id")

    return evidence.relax(["the", "that", "worthless"], search, 100, "doc_id")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem""")
def compound_key_positional(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return resolve.positions(Tables(spark, sf_dir).lineitem.select(*order), "pos", *map(F.col, order)).select("l_orderkey", "l_linenumber", "l_quantity", "pos")


@query("SELECT p_partkey, replace(p_name, ' ', '+') || '%2FC%3DC%2A~+-_.%C3%A9%25' AS plus, replace(p_name, ' ', '%20') || '/C%3DC%2A~%20-_.%C3%A9%25' AS percent FROM part")
def url_quote(spark, sf_dir):
    odd = F.concat("p_name", F.lit("/C=C*~ -_.é%"))
    return Tables(spark, sf_dir).part.select("p_partkey", dsl.quote(odd, plus=True).alias("plus"), dsl.quote(odd).alias("percent"))


@query("SELECT p_name, p_partkey FROM (SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name)")
def last_wins_map(spark, sf_dir):
    return resolve.last_wins(Tables(spark, sf_dir).part, ["p_name"], "p_partkey", "p_partkey").select("p_name", "p_partkey")


@query("SELECT c_custkey AS node_id FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey FROM supplier")
def union_distinct_nodes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("node_id")).unionByName(t.supplier.select(F.col("s_suppkey").alias("node_id"))).distinct()


@query("""
SELECT p_partkey, chr(10) || 'The gene name is ' || p_name || ' and the gene symbol is ' || p_brand || '.' || chr(10) || p_type || chr(10) || 'The gene synonyms are ' || p_name || ', ' || p_type
  || '.' || chr(10) || 'The gene is related to the proteins ' || p_brand || '.' || chr(10) || chr(10) AS doc FROM part""")
def gene_documents(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", evidence.gene_document(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.array("p_name", "p_type"), F.array("p_brand")).alias("doc"))


@query("""
WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL)
SELECT l_orderkey, l_suppkey, pos FROM f""")
def related_genes(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("pos"))
    return evidence.related_genes(rows, "l_orderkey", "l_suppkey", "pos", 3)


@query("SELECT conv_id AS index, string_agg('## ' || CASE turn % 2 WHEN 0 THEN 'KNOWLEDGE GRAPH INFORMATION' ELSE 'WIKIPEDIA INFORMATION' END || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS additional_info FROM conversations GROUP BY conv_id")
def tool_fan_in(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations
    info = F.when(F.col("turn") % 2 == 0, evidence.section(F.col("text"), evidence.ToolSpec.parse("kg"))).otherwise(evidence.section(F.col("text"), evidence.ToolSpec.parse("wikipedia")))
    return evidence.fan_in(rows.select(F.col("conv_id").alias("index"), F.col("turn").alias("tool_pos"), info.alias("info")))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(worthless|pathetic|trash)\\b', 1))) AS entity FROM documents")
def dictionary_tags(spark, sf_dir):
    ship(spark)
    terms = {w: "Word" for w in ("worthless", "pathetic", "trash")}
    return providers.tag(Tables(spark, sf_dir).documents, "doc_id", "text", lambda: providers.dictionary_tagger(terms)).select("doc_id", "entity")


_LETTERS = r"[\p{L}\p{N}_]+"


@query(rf"""
WITH names AS (
  SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier
  UNION SELECT w FROM (SELECT unnest(regexp_extract_all(text, '{_LETTERS}')) AS w FROM benchmark) WHERE length(w) >= 6
), words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_LETTERS}')) AS w FROM documents)
SELECT doc_id, name AS entity FROM words JOIN names ON w = name
UNION SELECT d.doc_id, n.name FROM documents d JOIN (SELECT name FROM names WHERE NOT regexp_full_match(name, '{_LETTERS}')) n ON contains(d.text, n.name)""")
def name_tags(spark, sf_dir):
    ship(spark)
    t = Tables(spark, sf_dir)
    named = [t.part.select(F.col("p_name").alias("name")), t.customer.select("c_name"), t.supplier.select("s_name")]
    spoken = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0))).alias("name")).where(F.length("name") >= 6)
    names = named[0].union(named[1]).union(named[2]).union(spoken).withColumn("tag", F.lit("Name"))
    return tagging.tag_names(t.documents, "doc_id", "text", names).select("doc_id", "entity").distinct()


@query("SELECT count(*) AS asked, sum(least(10, (SELECT count(*) FROM embeddings))) AS found, TRUE AS recalled FROM embeddings WHERE vec_id % 20 = 0")
def index_search(spark, sf_dir):
    """The index's neighbours against exact ones: ten for every query, and a recall of 0.9 or more."""
    ship(spark)
    rows = Tables(spark, sf_dir).embeddings
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = cells.search(cells.build(rows, key="vec_id"), asked, 10)
    truth = vectors.nearest_blocks(rows, asked, 10, key="vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = near.join(truth, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("asked"), F.count("*").alias("found"), (F.sum("hit") >= 0.9 * F.count("*")).alias("recalled"))
    return both


# a query an item: its first words of three letters or more, the last one dropped until five documents hold all that are left
@query(rf"""
WITH spoken AS (
  SELECT item_id AS index, w, min(i) AS i FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{_LETTERS}'), 1) AS i FROM benchmark) WHERE length(w) >= 3 GROUP BY ALL
), asked AS (SELECT index, row_number() OVER (PARTITION BY index ORDER BY i) - 1 AS pos, w FROM spoken QUALIFY pos < 4
), words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS w FROM documents
), m AS (SELECT index, count(*) AS n FROM asked GROUP BY index
), prefixes AS (SELECT a.index, a.pos, b.w FROM asked a JOIN asked b ON a.index = b.index AND b.pos <= a.pos
), hits AS (SELECT p.index, p.pos, w.doc_id FROM prefixes p JOIN words w USING (w) GROUP BY p.index, p.pos, w.doc_id HAVING count(*) = p.pos + 1
), best AS (SELECT h.index, h.doc_id, n - 1 - max(pos) AS round FROM hits h JOIN m USING (index) GROUP BY h.index, h.doc_id, n)
SELECT index, doc_id, round, row_number() OVER (PARTITION BY index ORDER BY round, doc_id) AS place FROM best QUALIFY place <= 5""")
def relaxation_each(spark, sf_dir):
    t = Tables(spark, sf_dir)
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_LETTERS), F.lit(0))
    spoken = t.benchmark.select(F.col("item_id").alias("index"), F.posexplode(letters("text")).alias("i", "term")).where(F.length("term") >= 3)
    first = spoken.groupBy("index", "term").agg(F.min("i").alias("i"))
    asked = first.withColumn("pos", F.row_number().over(Window.partitionBy("index").orderBy("i")) - 1).where("pos < 4").select("index", "pos", "term")
    postings = t.documents.select("doc_id", F.explode(F.array_distinct(letters("text"))).alias("term"))
    return evidence.relax_each(asked, postings, 5).select("index", "doc_id", "round", "place")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE doc_id IS NOT NULL
), words AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d
), totals AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS DOUBLE) AS total FROM d WHERE len(t) > 0
), asked AS (SELECT index, term, count(*) AS times FROM (SELECT item_id AS index, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL
), held AS (SELECT term, doc_id, n, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, floor(1e6::DOUBLE * ln(1 + (any_value(docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS w FROM held, totals GROUP BY term
), impacts AS (
  SELECT term, doc_id, CAST(floor(w * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (total / docs))))) AS BIGINT) AS impact FROM held JOIN weights USING (term), totals
), scores AS (SELECT index, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM impacts JOIN asked USING (term) GROUP BY index, doc_id)
SELECT index, doc_id, score, row_number() OVER (PARTITION BY index ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10""")
def question_passages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    questions = t.benchmark.select(F.col("item_id").alias("index"), F.col("text").alias("question"))
    return retrieval.best_passages(questions, t.documents)


@query(r"""
WITH spoken AS (SELECT p_partkey AS index, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) - 1 AS pos FROM part)
SELECT index, arg_min(word, pos) AS word, min(pos) AS pos FROM spoken WHERE length(word) >= 5 GROUP BY index""")
def first_success_word(spark, sf_dir):
    """The first word of each part's name and type that a service knows; this one knows words of five characters or more."""
    ship(spark)
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("index"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    service = lambda: lambda asked: ['{"name":"set"}' if len(w) >= 5 else '{"status":"error"}' for w in asked]
    found = providers.first_success(chains.words(rows, "text"), service, lambda r: F.get_json_object(r, "$.status").isNull())
    return found.select("index", "word", "pos")


# ---- streaming extension on tables ------------------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    rows = resume.windowed(Tables(spark, sf_dir).events)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return resume.sessions(Tables(spark, sf_dir).events).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
