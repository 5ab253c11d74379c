"""Readers (S01-S06, S09-S12, S16-S18, S22, S25) with explicit schemas; only the few header rows of a matrix are read on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dsl, python

_CONTEXT = "struct<perturbation_type:string,description:string,cell_type:string,`cell type`:string,disease_model:string,subtype:string>"
_ONE = "struct<type:string,`perturbation type`:string,smiles:string,name:string,target:string,moa_type:string,gene_symbol:string,`known targets`:string,pubchem_info:string>"
_INNER = f"context:string,perturbation:{_ONE},perturbations:array<{_ONE}>"
RECORD = f"index string, perturbation struct<{_INNER}>, context string, perturbations array<{_ONE}>, _corrupt_record string"
PRIMITIVES = "action string, description string, signature string"
PAPERS = "pmid string, title string, authors array<string>, abstract string, publication_year string"
REPORT = "index string, perturbation string, report_text string, question string, kg_info string, extracted_graph_info string, harmonizome_info string, wikipedia_info string, paperqa_info string, papers_info string, pubmed_info string"
EXPLANATION = "index string, input_perturbation string, thinking string, answer string, explain string, dag string, raw_response string, question string, input_report_text string, additional_info string"


def json_list(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file with one array of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON by suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return json_list(spark, path, schema)


def records(raw: DataFrame) -> DataFrame:
    """Index, pos, context and the perturbations of either shape as one array, aliases folded together."""
    inner = F.col("perturbation")
    many = F.coalesce(F.col("perturbations"), inner["perturbations"], F.when(inner["perturbation"].isNotNull(), F.array(inner["perturbation"])))
    fold = F.transform(many, lambda p: F.struct(
        F.coalesce(p["type"], p["perturbation type"]).alias("type"), p["smiles"].alias("smiles"), p["name"].alias("name"), p["target"].alias("target"), p["moa_type"].alias("moa_type"), p["gene_symbol"].alias("gene_symbol"),
        F.coalesce(F.from_json(p["known targets"], "array<string>"), F.split(p["known targets"], ",")).alias("known_targets"),
    ))
    context = F.coalesce(F.col("context"), inner["context"])
    parsed = F.coalesce(F.from_json(context, f"array<{_CONTEXT}>"), F.array())
    parsed = F.transform(parsed, lambda c: F.struct(c["perturbation_type"].alias("perturbation_type"), c["description"].alias("description"), F.coalesce(c["cell_type"], c["cell type"]).alias("cell_type"), c["disease_model"].alias("disease_model"), c["subtype"].alias("subtype")))
    return raw.where(many.isNotNull()).select("index", parsed.alias("context"), fold.alias("perturbations"))


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """Path, value of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labels (pos, label) and synonyms (synonym, label) of the first graph; the last label of a synonym wins."""
    schema = "graphs array<struct<nodes:array<struct<lbl:string,meta:struct<synonyms:array<struct<val:string>>>>>>>"
    nodes = json_list(spark, path, schema).select(F.posexplode(F.get("graphs", F.lit(0))["nodes"]).alias("pos", "n")).where("n.lbl is not null")
    labels = nodes.select("pos", F.col("n.lbl").alias("label"))
    synonyms = nodes.select("pos", F.col("n.lbl").alias("label"), F.explode("n.meta.synonyms").alias("s")).select("pos", "label", F.col("s.val").alias("synonym"))
    return labels, synonyms.groupBy("synonym").agg(F.max_by("label", "pos").alias("label"))


def drugs(spark: SparkSession, path: str) -> DataFrame:
    """alias_lc, priority (1 name, 2 synonym), drug_id; of equal aliases the last drug by file, block and place in the block wins."""
    schema = "`drugbank-id` array<string>, name string, synonyms struct<synonym:array<string>>"
    rows = spark.read.format("xml").option("rowTag", "drug").schema(schema).load(path)
    rows = rows.select(F.get("drugbank-id", F.lit(0)).alias("drug_id"), "name", F.col("synonyms.synonym").alias("synonyms"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos")).where("drug_id is not null")
    alias = rows.select(F.lower("name").alias("alias_lc"), F.lit(1).alias("priority"), "drug_id", "pos").unionByName(rows.select(F.explode(F.transform("synonyms", F.lower)).alias("alias_lc"), F.lit(2).alias("priority"), "drug_id", "pos"))
    return alias.where("alias_lc is not null").groupBy("alias_lc", "priority").agg(F.max_by("drug_id", "pos").alias("drug_id"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, or one that matches the pattern, on any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A Parquet table that is made once."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrix(spark: SparkSession, path: str, header: int = 3, index: int = 3, sparse: bool = False) -> DataFrame:
    """Row, col, row_keys, col_keys, value of a tab-separated matrix with so many header rows and index columns.

    Lines are read in splits; the header rows are the first lines of the first split, and row is the order of the lines,
    not their number. Slashes in labels become bars; repeated column labels get _1, _2 and so on; sparse: without zeros.
    """
    lines = spark.read.option("encoding", "latin1").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")).where("line <> ''")
    early = lines.where("block = 0").orderBy("id").limit(header)  # a few rows
    cells = lines.select("block", "id", F.split("line", "\t", -1).alias("cells"))
    heads = early.select("id", F.posexplode(F.split("line", "\t", -1)).alias("col", "label")).where(F.col("col") >= index)
    names = heads.groupBy("col").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "label"))), lambda r: F.replace(r["label"], F.lit("/"), F.lit("|"))).alias("col_keys"))
    again = F.row_number().over(Window.partitionBy("col_keys").orderBy("col")) - 1
    names = names.withColumn("_n", again).withColumn("col_keys", F.when(F.col("_n") > 0, F.concat(F.slice("col_keys", F.lit(1), F.size("col_keys") - 1), F.array(F.concat(F.element_at("col_keys", -1), F.lit("_"), F.col("_n").cast("string"))))).otherwise(F.col("col_keys"))).drop("_n")
    keys = F.transform(F.slice("cells", F.lit(1), F.lit(index)), lambda k: F.replace(k, F.lit("/"), F.lit("|")))
    top = [r.id for r in early.select("id").collect()]
    body = cells.where(~((F.col("block") == 0) & F.col("id").isin(top))) if top else cells
    body = body.select(F.struct("block", "id").alias("row"), keys.alias("row_keys"), F.posexplode("cells").alias("col", "text")).where(F.col("col") >= index)
    out = body.join(F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names, "col").select("row", "col", "row_keys", "col_keys", F.col("text").cast("double").alias("value"))
    return out.where("value <> 0") if sparse else out


def matrices(spark: SparkSession, files: dict[str, str], sparse: bool = False, **shape: int) -> DataFrame:
    """The matrices of data sets (name, path) as one table with a column dataset."""
    if not files:
        raise ValueError("no data set")
    return reduce(DataFrame.unionByName, (matrix(spark, path, sparse=sparse, **shape).withColumn("dataset", F.lit(name)) for name, path in files.items()))


def node_info(spark: SparkSession, path: str) -> DataFrame:
    """Pos, node_id, id, name, type, aliases of a JSON object keyed by node id; one alias may stand without a list."""
    kind = "map<string,struct<id:string,name:string,type:string,details:struct<alias:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("pos", "e"))
    alias = F.col("e.value.details.alias")
    listed = F.coalesce(F.from_json(alias, "array<string>"), F.when(alias.isNotNull() & ~alias.startswith("["), F.array(alias)))
    return rows.select("pos", F.col("e.key").cast("long").alias("node_id"), "e.value.id", "e.value.name", "e.value.type", listed.alias("aliases"))


def tagged_text(records: DataFrame, source: str) -> DataFrame:
    """Index, text of the perturbations that are tagged: the whole list, or, of other data sets than the two kinds of
    many, the one perturbation of a record that has one."""
    many = F.to_json("perturbations")
    one = F.when(F.size("perturbations") == 1, F.to_json(F.get("perturbations", F.lit(0)))).otherwise(many)
    return records.select("index", F.when(dsl.index_tag(F.lit(source)) == "", one).otherwise(many).alias("text"))


def literal_records(texts: DataFrame, column: str) -> DataFrame:
    """Records of a column of Python literals, as records() gives them; their index is the column index."""
    parsed = F.from_json(python.literal_to_json(F.col(column)), f"struct<context:string,perturbation:struct<{_INNER}>,perturbations:array<{_ONE}>>")
    rows = texts.where(F.col(column).isNotNull()).select("index", parsed.alias("r"))
    return records(rows.select("index", "r.perturbation", "r.context", "r.perturbations"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """S18."""
    return spark.read.option("header", True).option("sep", "\t").option("encoding", "latin1").csv(path)


def paper_files(spark: SparkSession, path: str) -> DataFrame:
    """Papers of text files with title and abstract."""
    files = text_file(spark, path)
    field = lambda name: F.nullif(F.trim(F.regexp_extract("value", f"(?m)^{name}: *(.*)$", 1)), F.lit(""))
    abstract = F.when(F.col("value").contains("Abstract\n"), F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?Abstract\n", ""), r"^\s+|\s+$", ""))
    rows = files.select("path", field("Title").alias("title"), field("Authors").alias("authors"), field("Venue").alias("venue"), field("Year").alias("year"), abstract.alias("abstract"))
    return rows.where("title is not null and abstract <> ''")


def usable_papers(papers: DataFrame) -> DataFrame:
    """Papers with an abstract, absent fields as N/A."""
    rows = papers.where(F.col("abstract").isNotNull() & (F.col("abstract") != "Abstract not found"))
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in rows.columns if c not in ("abstract", "title", "pmid")})
