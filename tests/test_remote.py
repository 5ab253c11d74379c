"""Connectors, judges, literals and the command line with offline stand-ins."""

import gzip
import json

from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions import python
from quarry.operators import judges
from quarry.operators.providers import table_lookup
from quarry.sources import remote

SERVICE = table_lookup({
    "gene/TP53": {"name": "tumor protein", "symbol": "TP53", "description": "d", "synonyms": ["p53"], "proteins": [{"symbol": "P"}]},
    "gene/a+b": {"status": "error"},
    "gene_set/skin": {"geneSets": [{"name": "s", "href": "set/1"}]},
    "set/1": {"associations": [{"gene": {"symbol": x}} for x in ("A", "B", "A", "C")]},
    "inchikey/K/cids/JSON": {"IdentifierList": {"CID": [5, 6]}},
    "smiles/C/C%3DC%2A/cids/JSON": {"IdentifierList": {"CID": [7]}},
    "name/nobody/cids/JSON": {"IdentifierList": {}},
    "cid/5/property/ConnectivitySMILES,SMILES,InChIKey,IUPACName/JSON": {"PropertyTable": {"Properties": [{"SMILES": "CC", "ConnectivitySMILES": "CC", "InChIKey": "K"}]}},
    "cid/5/synonyms/JSON": {"InformationList": {"Information": [{"Synonym": ["x", "CHEMBL9"]}]}},
    "cid/5/description/JSON": {"InformationList": {"Information": [{"Title": "T"}]}},
    "cid/7/property/ConnectivitySMILES,SMILES,InChIKey,IUPACName/JSON": {"PropertyTable": {"Properties": [{"IUPACName": "seven"}]}},
    "p1": {"next": "p2", "entities": [{"name": "a", "href": "h"}, {"name": "b", "href": "i"}]},
    "p2": {"next": "p1", "entities": [{"name": "c", "href": "j"}]},
    "dark/script_config": {"datasets": {"one": "path1"}, "downloads": ["m.txt.gz", "n.txt"]},
    "search/q%20r": {"ids": ["3", "1", "2"]},
    "search/s": {"ids": ["2"]},
    "fetch/1,2,3": {"papers": [{"pmid": "1", "title": "t", "abstract": None}, {"pmid": "2", "title": "u", "abstract": "v"}, {"pmid": "3", "title": "w", "abstract": "Abstract not found"}]},
    "EW": {"content": "text of EW"},
})


def test_genes(spark):
    rows = {r.name: r for r in remote.genes(spark.createDataFrame([("TP53",), ("a b",), ("none",), ("",)], "name string"), SERVICE).collect()}
    assert "gene symbol is TP53" in rows["TP53"].doc and rows["TP53"].error is None
    assert rows["a b"].error == "status" and rows["none"].error.startswith("KeyError") and len(rows) == 3
    sets = remote.gene_sets(spark.createDataFrame([("skin",), ("none",)], "name string"), SERVICE, 3)
    assert sorted((r.symbol, r.pos) for r in sets.collect()) == [("A", 0), ("B", 1)]
    found = remote.pages(spark, "p1", SERVICE)
    assert [r.request for r in found.orderBy("pos").collect()] == ["p1", "p2"]
    assert [(r.page, r.pos, r.name) for r in remote.entities(found).orderBy("page", "pos").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_pages_has_no_last_page_of_its_own(spark):
    book = table_lookup({f"p{k}": {"next": f"p{k + 1}"} if k < 1500 else {} for k in range(1501)})
    assert [r.request for r in remote.pages(spark, "p0", book).orderBy("pos").collect()] == [f"p{k}" for k in range(1501)]
    assert remote.pages(spark, "none", book).first().reply is None


def test_catalog_and_downloads(spark):
    sets, names = remote.catalog(spark, SERVICE)
    assert [tuple(r) for r in sets.collect()] == [("one", "path1")] and [r.download for r in names.orderBy("pos").collect()] == ["m.txt.gz", "n.txt"]
    wanted = sets.select("dataset").unionByName(spark.createDataFrame([("two",)], "dataset string")).crossJoin(names.select("download"))
    files = {"path1/m.txt.gz": gzip.compress(b"matrix"), "path1/n.txt": b"plain"}
    rows = {(r.dataset, r.download): (bytes(r.content) if r.content else None, r.error) for r in remote.downloads(sets, wanted, lambda: files.__getitem__).collect()}
    assert rows["one", "m.txt"] == (b"matrix", None) and rows["one", "n.txt"] == (b"plain", None)
    assert rows["two", "n.txt"][1] == "ValueError: two is not a valid dataset name"
    done = spark.createDataFrame([("one", "n.txt")], "dataset string, download string")
    assert remote.downloads(sets, wanted, lambda: files.__getitem__, done).count() == 3


def test_compounds_papers_encyclopedia(spark):
    keys = spark.createDataFrame([("n", "s", "K"), (None, None, None)], "name string, smiles string, inchikey string")
    rows = {r.name: r for r in remote.compounds(keys, SERVICE).collect()}
    assert rows["n"].compound.chembl_id == "CHEMBL9" and rows["n"].compound.cid == 5 and rows["n"].compound.name == "T" and rows["n"].compound.warning is None
    assert rows[None].compound is None and rows[None].error == "no key"
    keys = spark.createDataFrame([("a", " C/C=C* ", None), ("nobody", None, None), ("gone", None, None)], "name string, smiles string, inchikey string")
    rows = {r.name: r for r in remote.compounds(keys, SERVICE).collect()}
    assert rows["a"].compound.name == "seven" and rows["a"].compound.synonyms == [] and rows["a"].compound.warning.startswith("Record found")
    assert rows["nobody"].error == "No result found in PubChem." and rows["gone"].error.startswith("KeyError")
    found = remote.papers(spark.createDataFrame([("q r",), ("s",)], "query string"), SERVICE).collect()
    assert sorted((r.query, r.pos, r.paper.pmid) for r in found) == [("q r", 2, "2"), ("s", 0, "2")]
    info = remote.encyclopedia(spark.createDataFrame([(1, 0, "EW"), (1, 1, "gone"), (1, 2, "EW")], "index int, pos int, entity string"), SERVICE).collect()
    assert [r.info for r in info] == ["## EW\ntext of EW"]


def test_judges(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, f string")
    said = lambda: lambda prompts: [f"<answer>{'yes' if p[0] == p[2] else 'no'}</answer>" + '{"x": 5}' for p in prompts]
    assert sorted(r.correctness for r in judges.correctness(rows, "{truth} {found}", said, "t", "f").collect()) == [0.0, 1.0]
    assert {r.plausibility.x for r in judges.plausibility(rows, "{found} q", said, "f", ["x"]).collect()} == {0.5}


def test_literals(spark):
    df = spark.createDataFrame([("{'a': [1, None]}",), ("nope(",), (None,)], "t string")
    assert [r.v for r in df.select(python.literal_to_json("t").alias("v")).collect()] == ['{"a": [1, null]}', None, None]
    df = spark.createDataFrame([('{"a":"é"}',)], "t string")
    assert df.select(python.pretty_json("t").alias("v")).first().v == json.dumps({"a": "é"}, indent=4)
    assert df.select(python.trim_tokens(F.col("t"), list, "".join, 3).alias("v")).first().v == '{"a'


def test_command_line(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"index": "1", "perturbation": {"perturbations": [{"name": "x"}]}}]))
    main(["normalise", "--input", f"{tmp_path}/r.json", "--output", f"{tmp_path}/records"])
    assert spark.read.parquet(f"{tmp_path}/records").count() == 1
    (tmp_path / "e.json").write_text(json.dumps([{"index": "1", "explain": "a(id=\"n0\")\nb(id=\"n1\")", "dag": "", "raw_response": ""}]))
    (tmp_path / "v.json").write_text(json.dumps([{"action": "a"}]))
    main(["evaluate", "--truth", f"{tmp_path}/e.json", "--found", f"{tmp_path}/e.json", "--vocabulary", f"{tmp_path}/v.json", "--output", f"{tmp_path}/out"])
    got = {r.metric: r.value for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()}
    assert got["syntax"] == 0.5 and got["id_coherence"] == 1
    for name, text in (("report", "R {treatment}"), ("explain", "{action_primitives} {report}"), ("primitives", "p")):
        (tmp_path / f"{name}.txt").write_text(text)
    spark.createDataFrame([("1", "known")], "index string, info string").write.parquet(f"{tmp_path}/kg.parquet")
    call = ["generate", "--records", f"{tmp_path}/records.parquet", "--output", f"{tmp_path}/made", "--report-template", f"{tmp_path}/report.txt", "--explain-template", f"{tmp_path}/explain.txt", "--primitives", f"{tmp_path}/primitives.txt", "--model", "quarry.operators.providers:echo", "--tools", json.dumps({"kg": f"{tmp_path}/kg.parquet"})]
    spark.read.parquet(f"{tmp_path}/records").write.parquet(f"{tmp_path}/records.parquet")
    for _ in range(2):  # the second call finds nothing left to do
        main(call)
    assert spark.read.parquet(f"{tmp_path}/made/explanations").count() == spark.read.parquet(f"{tmp_path}/made/reports").count() == 1
