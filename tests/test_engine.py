"""Golden values, branches and properties of the engine's operators on small inputs."""

import json
import math
import pickle
import random
import urllib.parse
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import dsl, metrics, text
from quarry.operators import chains, client, evidence, graph, providers, resolve, vectors
from quarry.plans import catalogue, lifecycle
from quarry.sources import convert, readers, sinks
from quarry.streaming import resume

EXPLAIN = 'set_context(id="n0", a="b")\n  binds_to(id="n1", x="y")\nmade_up(id="n2")\nbinds_to(id="n3")'
DAG = 'edge("n1", "n2", relation="causal")\nedge("n2", "n3", relation="causal")\nedge("n1", "n2", relation="correlative")'


def one(spark, column, **values):
    names = values or {"_": 1}
    df = spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in names.items()))
    return df.select(column.alias("v")).first().v


def test_primitives_and_ids(spark):
    assert one(spark, dsl.primitives(F.col("t")), t=EXPLAIN) == ["set_context", "binds_to", "made_up", "binds_to"]
    assert one(spark, dsl.primitives(F.col("t")), t=None) == []
    assert one(spark, dsl.defined_ids(F.col("t")), t=EXPLAIN) == ["n0", "n1", "n2", "n3"]


def test_edges_keep_last_relation(spark):
    got = [tuple(e) for e in one(spark, dsl.edges(F.col("t")), t=DAG)]
    assert got == [("n1", "n2", "correlative"), ("n2", "n3", "causal")]
    assert one(spark, dsl.edges(F.col("t")), t=None) == []


def test_sections(spark):
    assert one(spark, dsl.section(F.col("t"), "dag"), t="x<DAG>\n a \n</dag><dag>b</dag>") == "a"
    assert one(spark, dsl.strict_section(F.col("t"), "dag"), t="<DAG>a</DAG>") is None
    assert one(spark, dsl.section(F.col("t"), "dag"), t=None) == ""
    whole = "<think>a</think><answer></answer><explain>b</explain><dag>c</dag>"
    assert one(spark, metrics.schema_validity(F.col("t")), t=whole) == 1
    assert one(spark, metrics.schema_validity(F.col("t")), t=whole.upper()) == 0
    assert one(spark, metrics.schema_validity(F.col("t")), t=None) == 0


def test_scores(spark):
    words = F.array(F.lit("binds_to"), F.lit("set_context"))
    assert one(spark, metrics.validity(F.col("t"), words), t=EXPLAIN) == 0.75
    assert one(spark, metrics.validity(F.col("t"), words), t="") == 0
    assert one(spark, metrics.id_coherence(F.col("t"), F.col("d")), t=EXPLAIN, d=DAG) == 1
    assert one(spark, metrics.id_coherence(F.col("t"), F.col("d")), t=EXPLAIN, d='edge("n0", "n1", relation="causal")') == 0
    assert one(spark, metrics.id_coherence(F.col("t"), F.col("d")), t="one line", d="") == 0
    assert one(spark, metrics.edge_f1(dsl.edges(F.col("d")), dsl.edges(F.col("d"))), d=DAG).f1 == 1
    assert one(spark, metrics.edge_f1(dsl.edges(F.col("d")), dsl.edges(F.col("t"))), d=DAG, t=None).f1 == 0


@pytest.mark.parametrize(("dag", "want"), [(DAG, 1), ("", 1), (None, 1), ('edge("n1", "n1", relation="causal")', 0), (DAG + '\nedge("n3", "n1", relation="causal")', 0)])
def test_acyclic(spark, dag, want):
    assert one(spark, metrics.acyclic(dsl.edges(F.col("d"))), d=dag) == want


def test_acyclic_against_peeling(spark):
    rng = random.Random(1)
    graphs = [[(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(9))] for _ in range(150)]

    def plain(pairs):
        while pairs and (rest := [p for p in pairs if any(q[1] == p[0] for q in pairs)]) != pairs:
            pairs = rest
        return int(not pairs)

    df = spark.createDataFrame([(k, "\n".join(f'edge("n{a}", "n{b}", relation="r")' for a, b in g)) for k, g in enumerate(graphs)], "k int, d string")
    got = {r.k: r.v for r in df.select("k", metrics.acyclic(dsl.edges(F.col("d"))).alias("v")).collect()}
    assert got == {k: plain(g) for k, g in enumerate(graphs)} and set(got.values()) == {0, 1}


@pytest.mark.parametrize("line", ["edge('n1', 'n2', relation='x')", 'edge( "n1", "n2", relation="x")', 'edge("n1", "n2", relation = "x")', 'edge("n1" , "n2", relation="x")', 'edge("n1", "n2", relation="x" )', 'edge("m1", "n2", relation="x")'])
def test_edges_are_of_one_form(spark, line):
    assert one(spark, dsl.edges(F.col("t")), t=line) == []


def test_judges(spark):
    assert one(spark, metrics.correctness(F.col("t")), t="so <answer>YES</answer>") == 1
    assert one(spark, metrics.correctness(F.col("t")), t="so <answer> yes</answer>") == 0
    assert one(spark, metrics.correctness(F.col("t")), t="so") is None
    got = one(spark, dsl.judge_scores(F.col("t"), ["a", "b"]), t='x {"a": 7, "b": "bad"} y')
    assert (got.a, got.b) == (0.7, 0.0)


def test_text_metrics(spark):
    assert one(spark, metrics.rouge_n(F.col("a"), F.col("b")), a="the cat sat", b="the cat ran") == pytest.approx(2 / 3)
    assert one(spark, metrics.rouge_n(F.col("a"), F.col("b"), 2), a="the cat sat", b="the cat ran") == pytest.approx(1 / 2)
    assert one(spark, metrics.rouge_l(F.col("a"), F.col("b")), a="a b c d", b="a c d") == pytest.approx(6 / 7)
    assert text.corpus_bleu(["a b c d e"], ["a b c d e"]) == pytest.approx(1)
    assert text.corpus_bleu([""], ["a"]) == text.corpus_bleu(["a", "b"], ["a"]) == text.corpus_bleu([], []) == 0
    # 2 of 3 words and 1 of 2 pairs; no triple counts as half a hit of one
    assert text.corpus_bleu(["the cat sat"], ["the cat ran"]) == pytest.approx((2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    # counts are summed over the parts, lengths too
    assert text.corpus_bleu(["a b", "c"], ["a b", "d c"]) == pytest.approx(math.exp(1 - 4 / 3) * (1 * 1) ** 0.5)
    assert text.tokens_13a("It's 3.5, isn't it? x-1 2-3 &lt;") == ["It's", "3.5", ",", "isn't", "it", "?", "x-1", "2", "-", "3", "<"]
    df = spark.createDataFrame([(1, "A b. C d.", "A b. C e."), (2, None, "x")], "k int, t string, f string")
    rows = {r.k: r for r in metrics.token_scores(df, "k", "t", "f", "paragraph").collect()}
    assert rows[1].rouge1_macro == pytest.approx(0.75)
    assert rows[2].rouge1_micro == 0


# Stems that the stemmer's published vocabulary gives.
STEMS = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "news": "news"}


def test_stems():
    assert {w: text.stem(w) for w in STEMS} == STEMS


def test_meteor():
    assert text.meteor("the cat sat on the mat".split(), "the cat sat on the mat".split()) == pytest.approx(1 - 0.5 / 6**3)
    assert text.meteor("running dogs".split(), "dogs run".split()) == pytest.approx(1 - 0.5)  # both matched, one by its stem, in two chunks
    assert text.meteor(["a"], ["b"]) == text.meteor([], ["b"]) == text.meteor(["a"], []) == 0
    assert text.meteor(["big"], ["large"], same=lambda w: ["big", "large"] if w in ("big", "large") else [w]) == pytest.approx(0.5)
    p, r = 2 / 3, 2 / 4
    assert text.meteor("a b c d".split(), "a x b".split()) == pytest.approx(p * r / (0.9 * p + 0.1 * r) * 0.5)


def test_natural_key_and_quotes(spark):
    df = spark.createDataFrame([("b10",), ("b9",), ("B1",)], "s string")
    assert [r.s for r in df.orderBy(dsl.natural_key(F.col("s"))).collect()] == ["B1", "b9", "b10"]
    df = spark.createDataFrame([("a" + "1" * 22,), ("a" + "9" * 21,), ("a007",), ("a",), ("a8x",)], "s string")
    assert [r.s for r in df.orderBy(dsl.natural_key(F.col("s"))).collect()] == ["a", "a007", "a8x", "a" + "9" * 21, "a" + "1" * 22]
    odd = "a b/C=C*~-_.é%+"
    assert one(spark, dsl.quote(F.col("t")), t=odd) == urllib.parse.quote(odd)
    assert one(spark, dsl.quote(F.col("t"), plus=True), t=odd) == urllib.parse.quote_plus(odd)
    assert one(spark, dsl.index_tag(F.col("t")), t="/x/rxrx_19.json") == "rxrx_19_"


def test_cascade(spark):
    mentions = spark.createDataFrame([("TP53", "Gene"), ("p53", "Gene"), ("P53", "Gene"), ("flu", "Disease"), ("gone", "Disease"), ("p53", "Other")], "entity string, tag string")
    nodes = spark.createDataFrame([("tp53", 1), ("TP53", 2), ("influenza", 3)], "name string, id int")
    alias = spark.createDataFrame([("p53", 2)], "alias string, id int")
    synonyms = spark.createDataFrame([("flu", 3)], "alias string, id int")
    got = resolve.resolve(mentions, [
        resolve.candidate(nodes, F.lower("name"), F.col("id"), 1),
        resolve.candidate(alias, F.col("alias"), F.col("id"), 2, "Gene", fold=False),
        resolve.candidate(synonyms, F.col("alias"), F.col("id"), 2, "Disease", fold=False),
    ])
    found = {(r.entity, r.tag): (r.node_id, r.priority) for r in got.collect()}
    assert found == {("TP53", "Gene"): (2, 1), ("p53", "Gene"): (2, 2), ("P53", "Gene"): (None, None), ("flu", "Disease"): (3, 2), ("gone", "Disease"): (None, None), ("p53", "Other"): (None, None)}
    assert resolve.unmatched(got).count() == 3


def test_dedupe_ignores_index_at_depth(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"pos":1,"a":{"index":1,"x":[2,1]}}', '{"pos":2,"a":{"index":9,"x":[2,1]}}', '{"pos":3,"a":{"index":9,"x":[1,2]}}']))
    assert [r.pos for r in resolve.dedupe(rows, "pos").orderBy("pos").collect()] == [1, 3]
    assert [r.pos for r in resolve.dedupe(rows, "pos", "last").orderBy("pos").collect()] == [2, 3]
    assert [r.pos for r in resolve.dedupe(rows, "pos", multiset=True).collect()] == [1]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src long, dst long").withColumn("edge_id", F.monotonically_increasing_id())
    got = {r.node_id: r.dist for r in graph.distances(edges, spark.createDataFrame([(1,)], "node_id long"), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    tree = {(r.src, r.dst) for r in graph.connecting_subgraph(edges, [1, 4]).collect()}
    assert tree == {(3, 1), (3, 4)}
    assert graph.k_hop_edges(edges, spark.createDataFrame([(4,)], "node_id long"), 1).count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "node_id long, embedding array<float>")
    assert [r.node_id for r in vectors.similar(df, [1.0, 0.0], 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.similar(df, [1.0], metric="other")
    plan = vectors.similar(df, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    got = vectors.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda part: [[float(len(x))] for x in part])
    assert sorted(r.embedding[0] for r in got.collect()) == [0.0, 2.0]


def test_providers(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "q string")

    def make():
        def run(part):
            if "bad" in part:
                raise ValueError("no")
            return [x * 2 for x in part]

        return run

    replies = providers.call_once(rows, "q", make)
    got = {r.request: (r.reply, r.error) for r in replies.collect()}
    assert got == {"a": ("aa", None), "bad": (None, "ValueError: no")}
    replay = spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", "old")], "key string, reply string")
    again = providers.join_back(rows, "q", providers.call_once(rows, "q", make, replay))
    assert sorted(str(r.reply) for r in again.collect()) == ["None", "None", "old", "old"]


def test_short_replies_are_errors_and_replies_are_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}") for k in range(5)], "k int, q string")
    short = lambda: lambda part: [x for x in part if x != "q3"]
    got = {r.request: (r.reply, r.error) for r in providers.call_once(rows, "q", short).collect()}
    assert {k: v[0] for k, v in got.items()} == {"q0": "q0", "q1": "q1", "q2": "q2", "q3": None, "q4": "q4"} and got["q3"][1].startswith("ValueError")

    def counting():
        def run(part):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write("".join(f"{x}\n" for x in part))
            return [f"<answer>{uuid.uuid4()}</answer>" for _ in part]

        return run

    reports, told = lifecycle.generate(spark.createDataFrame([("1", "p")], "index string, perturbation string"), [], "R {treatment}", "{report}", "", "How?", counting)
    report, said = reports.first(), told.first()
    assert report.report_text == reports.first().report_text == said.input_report_text and said.answer
    asked = (tmp_path / "calls").read_text().split("\n")
    assert asked == ["R p", report.report_text, ""]


def test_evidence(spark):
    spec = evidence.ToolSpec.parse("kg-ner-fast")
    assert spec.base == "kg" and "ner" in spec.modifiers
    with pytest.raises(ValueError):
        evidence.ToolSpec.parse("other")
    assert one(spark, evidence.report_prompt("R {treatment}\n### EXPECTED OUTPUT", F.col("t"), F.col("i")), t="T", i="") == "R T\n### EXPECTED OUTPUT"
    assert "# ADDITIONAL INFORMATION\nI\n" in one(spark, evidence.report_prompt("R {treatment}\n### EXPECTED OUTPUT", F.col("t"), F.col("i")), t="T", i="I")
    assert one(spark, evidence.explain_prompt("## Additional information\n{information}Q {question}", question=F.col("q"), information=F.col("i")), q="x", i="") == "Q x"
    got = one(spark, evidence.node_records(F.col("t")), t="- name: A: b\n- kind: c\n\n- name: D\n\n")
    assert got == [[{"name": "A: b"}, {"kind": "c"}], [{"name": "D"}]]
    got = one(spark, evidence.heading_records(F.col("t")), t="## X\nline\nmore\n## Y\nz")
    assert [tuple(r) for r in got] == [("X", "line\nmore"), ("Y", "z")]


def test_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"graphs": [{"nodes": [{"lbl": "A", "meta": {"synonyms": [{"val": "a1"}, {"val": "x"}]}}, {"id": 1}, {"lbl": "B", "meta": {"synonyms": [{"val": "x"}]}}]}]}))
    labels, synonyms = readers.ontology(spark, str(tmp_path / "o.json"))
    assert {r.label for r in labels.collect()} == {"A", "B"}
    assert {(r.synonym, r.label) for r in synonyms.collect()} == {("a1", "A"), ("x", "B")}
    (tmp_path / "d.xml").write_text("<db><drug><drugbank-id>DB1</drugbank-id><name>Asp</name><synonyms><synonym>ASA</synonym></synonyms></drug><drug><drugbank-id>DB2</drugbank-id><name>asp</name></drug></db>")
    assert {(r.alias_lc, r.priority, r.drug_id) for r in readers.drugs(spark, str(tmp_path / "d.xml")).collect()} == {("asp", 1, "DB2"), ("asa", 2, "DB1")}
    (tmp_path / "m.tsv").write_text("#\t#\tc1\tA/x\tA/x\n#\t#\tc2\tB\tB\nr1\tr2\tr3\tp\tp\ng/1\ti\tj\t1.5\t0\n")
    cells = {(tuple(r.row_keys), tuple(r.col_keys)): r.value for r in readers.matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert cells == {(("g|1", "i", "j"), ("A|x", "B", "p")): 1.5, (("g|1", "i", "j"), ("A|x", "B", "p_1")): 0.0}
    assert readers.matrix(spark, str(tmp_path / "m.tsv"), sparse=True).count() == 1
    (tmp_path / "p.txt").write_text("Title: T\nAuthors: X\nVenue: V\nYear: 2020\nAbstract\nbody\nmore")
    (tmp_path / "q.txt").write_text("Title: none")
    got = readers.paper_files(spark, str(tmp_path / "*.txt")).collect()
    assert [(r.title, r.year, r.abstract) for r in got] == [("T", "2020", "body\nmore")]


RECORD = {"index": "1", "perturbation": {"context": [{"cell type": "skin"}], "perturbations": [{"type": "chemical", "name": "EW", "smiles": "CC", "known targets": ["A", "B"]}]}}


def test_lifecycle_twice_gives_the_same(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([RECORD, {"index": "2", "perturbation": {"context": [], "perturbation": {"perturbation type": "genetic", "name": "EW"}}}, {"index": "3"}]))
    records = readers.records(readers.json_list(spark, str(tmp_path / "r.json"), readers.RECORD))
    assert records.count() == 2
    first = records.where("index = '1'").select(F.col("context")[0]["cell_type"], F.col("perturbations")[0]["known_targets"]).first()
    assert tuple(first) == ("skin", ["A", "B"])
    compounds = spark.createDataFrame([("CC", ["DB12", "plain"])], "smiles string, synonyms array<string>")
    tags = lifecycle.preprocess(records, lambda: providers.dictionary_tagger({"EW": "Chemical"}), compounds=compounds)
    got = {(r["index"], r.side, r.entity) for r in tags.collect()}
    assert got == {("1", "perturbation", "EW"), ("2", "perturbation", "EW"), ("1", "perturbation", "plain")}
    rows = records.select("index", F.to_json("perturbations").alias("perturbation"))
    info = rows.select("index", F.lit("known").alias("info"))
    run = lambda: lifecycle.generate(rows, [("kg", info)], "R {treatment}\n### EXPECTED OUTPUT", "{action_primitives} {report} {question}", "p", "How?", providers.echo)
    reports, told = run()
    told = told.withColumn("x", F.lit(1)).drop("x")
    assert "KNOWLEDGE GRAPH INFORMATION\nknown" in reports.first().additional_info
    assert sorted(map(str, told.collect())) == sorted(map(str, run()[1].collect()))
    sinks.write_table(told, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    scores = lifecycle.evaluate(again, again, ["set_context", "similar_to"])
    r = scores.first()
    assert (r.syntax, r.schema_validity, r.id_coherence, r.dag_well_formed, r.edge_type_accuracy, r.primitive_level_f1) == (1.0, 1, 1, 0, 1.0, 1.0)
    encoders = {"lengths": lambda: lambda texts: [[float(len(x)), 1.0] for x in texts]}
    tokens = {"words": lambda: lambda texts: [[[float(len(w)), 1.0] for w in x.split()] for x in texts]}
    judge = lambda: lambda prompts: ['<answer>yes</answer> {"depth": 7}' for _ in prompts]
    full = lifecycle.evaluate(again, again, ["set_context"], lifecycle.METRICS, encoders, tokens, judge, "{question} {answer} {completion}", "{question} {completion}", ("depth",))
    r = full.first()
    assert r["argument_similarity/paragraph/lengths"] == r["argument_similarity/structure_hypothesis/words"] == r["llm/correctness"] == 1.0
    assert r["llm/plausibility/depth"] == 0.7 and r["token_accuracy/paragraph"].rouge1_micro == 1.0
    assert "token_accuracy/paragraph/bleu_micro" in {m.metric for m in metrics.means(full).collect()}
    with pytest.raises(ValueError):
        lifecycle.evaluate(again, again, [], ("argument_similarity",))
    means = {m.metric: m.value for m in metrics.means(scores).collect()}
    assert means["primitive_level_f1"] == 1.0


def test_conversion(spark, tmp_path):
    np.save(tmp_path / "e.npy", np.array([[0, 1, 2], [1, 2, 0]]))
    types = np.array([5, 6, 5])
    edges, nodes = convert.graph(spark, convert.array(str(tmp_path / "e.npy")), types, np.array([1, 2, 3]), str(tmp_path / "g"))
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1, 5), (1, 1, 2, 6), (2, 2, 0, 5)] and nodes.count() == 3
    (tmp_path / "d.pkl").write_bytes(pickle.dumps({3: "x", 4: None}))
    assert {(r.key, r.value) for r in convert.dictionary(spark, str(tmp_path / "d.pkl")).collect()} == {(3, "x"), (4, None)}
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(json.JSONDecoder))
    with pytest.raises(pickle.UnpicklingError):
        convert.dictionary(spark, str(tmp_path / "bad.pkl"))
    (tmp_path / "n.json").write_text(json.dumps({"7": {"id": "G1", "name": "A", "type": "gene/protein", "details": {"alias": ["a", "b"]}}, "8": {"id": "DB1", "name": "B", "type": "drug", "details": {"alias": "one"}}, "9": {"name": "C"}}))
    info = readers.node_info(spark, str(tmp_path / "n.json"))
    assert {(r.node_id, r.name, tuple(r.aliases or ())) for r in info.collect()} == {(7, "A", ("a", "b")), (8, "B", ("one",)), (9, "C", ())}
    named = spark.createDataFrame([(7, "A"), (8, "B")], "node_id long, name string")
    assert {(r.alias, r.node_id) for r in chains.gene_aliases(info, named).collect()} == {("a", 7), ("b", 7)}
    assert [(r.drug_id, r.name) for r in chains.drug_names(info).collect()] == [("DB1", "B")]
    sinks.write_timed(edges, str(tmp_path / "t"), "edges", str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().rows == 3


def test_gene_and_paper_schemas(spark):
    genes = spark.createDataFrame([("1", "g", "S", "d")], "index string, name string, symbol string, description string")
    sets = spark.createDataFrame([("1", "skin"), ("2", "none")], "index string, name string")
    related = spark.createDataFrame([("skin", 1, "B"), ("skin", 0, "A")], "name string, pos int, symbol string")
    rows = evidence.gene_records(genes, sets, related)
    got = {r["index"]: json.loads(r.v) for r in rows.select("index", evidence.schema_text(F.col("info"), "harmonizome-schema").alias("v")).collect()}
    assert [g["gene_name"] or g["gene_set_name"] for g in got["1"]["Gene information"]] == ["g", "skin"] and got["1"]["Gene information"][1]["related_genes"] == ["A", "B"]
    assert got["2"]["Gene information"][0]["related_genes"] is None
    assert json.loads(one(spark, evidence.schema_text(F.col("t"), "kg-schema"), t="- name: A\n\n")) == {"KG nodes": [[{"name": "A"}]]}
    assert json.loads(one(spark, evidence.schema_text(F.col("t"), "wikipedia"), t="## X\ny"))["wikipedia_info"] == [{"entity_name": "X", "context": "y"}]


def test_gene_evidence(spark):
    records = spark.createDataFrame([("1", [("skin",)], [("chemical", "EW", None, ["T1", "gone"]), ("genetic", None, "T2", None)])], "index string, context array<struct<cell_type:string>>, perturbations array<struct<type:string,name:string,gene_symbol:string,known_targets:array<string>>>")
    genes = spark.createDataFrame([("T1", "doc1;"), ("T2", "doc2;")], "name string, doc string")
    related = spark.createDataFrame([("EW", 0, "T2"), ("EW", 1, "Z")], "name string, pos int, symbol string")
    sets = chains.gene_set_text(related, genes)
    assert sets.first().text == "\nThe related genes are T2, Z.\n\nThe gene information is as follows:\ndoc2;"
    info = chains.gene_evidence(records, genes, sets).first().info
    assert info.index("is T1. doc1;") < info.index("is T2. doc2;") < info.index("### PERTURBATION NAME INFORMATION") and "CELL TYPE" not in info


def test_literal_records(spark):
    rows = spark.createDataFrame([("1", "{'perturbation': {'context': [{'cell type': 'skin'}], 'perturbations': [{'name': 'x'}]}}"), ("2", None)], "index string, t string")
    got = readers.literal_records(rows, "t").collect()
    assert [(r["index"], r.context[0].cell_type, r.perturbations[0].name) for r in got] == [("1", "skin", "x")]


def test_nearest_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k), 1.0]) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    asked = df.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    for metric in vectors.METRICS:
        a, b = ({(r.query_id, r.node_id, round(r.score, 9)) for r in f.collect()} for f in (vectors.nearest_blocks(df, asked, 5, metric, blocks=4), vectors.similar_each(df, asked, 5, metric)))
        assert a == b and len(a) == 10


def test_best_rows_of_a_block(monkeypatch):
    """All metrics against sorting all scores, with ties, rows without a length and missing parts; and norms are taken once a block, not once a query."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * np.exp(rng.normal(size=(700, 1)) * 3)
    x[100:140], x[200], x[201, 2] = x[0], 0, np.nan
    ids, asked = rng.permutation(700), np.concatenate([x[:60], np.zeros((1, 6))])
    passed, norm = [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda v, **a: passed.append(np.size(v)) or norm(v, **a))
    for metric, k in (("cosine", 7), ("l2", 7), ("dot", 7), ("cosine", 900)):
        passed.clear()
        got = list(vectors.best_of(x, ids, asked, k, metric))
        assert k == 900 or sum(passed) < asked.size + 0.1 * len(asked) * x.size
        assert len(got) == len(asked)
        for q, (top, s) in zip(asked, got):
            with np.errstate(all="ignore"):
                want = 1 / (1 + norm(x - q, axis=1)) if metric == "l2" else (x * q).sum(1)
                want = want / (norm(x, axis=1) * norm(q)) if metric == "cosine" else want
            order = np.lexsort((ids, -np.nan_to_num(want, nan=-np.inf)))[:k]
            assert top.tolist() == order.tolist() and np.array_equal(s, want[order], equal_nan=True)


def test_messages_and_settings(spark, monkeypatch):
    rows = spark.createDataFrame([("hi", '{"content": "so", "tool_calls": [{"id": "1", "name": "look", "arguments": "{}"}]}'), ("ho", "plain")], "q string, r string")
    tools = [client.tool("look", "d", {"x": "string"})]
    asked = rows.select("q", client.as_request(client.conversation(F.col("q"), "be brief"), tools).alias("a"), client.parsed_reply(F.col("r")).alias("p"))
    got = {r.q: r for r in asked.collect()}
    body = json.loads(got["hi"].a)
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["messages"][1]["content"] == "hi" and body["tools"] == tools
    assert got["hi"].p.tool_calls[0].name == "look" and got["ho"].p.content == "plain" and got["ho"].p.tool_calls is None
    more = rows.select("q", client.continued(client.conversation(F.col("q")), client.parsed_reply(F.col("r")), F.array(F.lit("seen"))).alias("m")).collect()
    assert {r.q: [(m.role, m.content) for m in r.m] for r in more} == {"hi": [("user", "hi"), ("assistant", "so"), ("tool", "seen")], "ho": [("user", "ho"), ("assistant", "plain")]}
    monkeypatch.setenv("QUARRY_KEY", "x")
    assert client.setting(spark, "QUARRY_KEY") == "x" and client.setting(spark, "QUARRY_NONE") is None and client.setting(spark, "QUARRY_NONE", "d") == "d"
    with pytest.warns(UserWarning):
        assert client.optional(lambda: spark.read.parquet("/nowhere"), "index") is None


def test_distances_without_a_limit(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    got = {r.node_id: r.dist for r in graph.distances(edges, spark.createDataFrame([(0,)], "node_id long"), None).collect()}
    assert got == {k: k for k in range(13)}
    assert graph.connecting_subgraph(edges.withColumn("edge_id", F.col("src")), [0, 12]).count() == 12


def test_stream_processes_files_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    for _ in range(2):
        resume.process_new(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), target, str(tmp_path / "check"))
    assert spark.read.parquet(target).count() == 3
    spark.range(3, 5).write.mode("append").parquet(source)
    resume.process_new(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), target, str(tmp_path / "check"))
    assert spark.read.parquet(target).count() == 5


def test_steiner_query_takes_all_edges(spark, monkeypatch, tmp_path):
    sizes = {"nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 0), (5, 0)]), "customer": ("c_nationkey int, c_custkey long", [(0, 1), (1, 2)]), "supplier": ("s_nationkey int, s_suppkey long", [(5, 1)])}
    for name, (schema, rows) in sizes.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = []
    find = graph.connecting_subgraph
    monkeypatch.setattr(graph, "connecting_subgraph", lambda edges, *more: asked.append(edges.count()) or find(edges, *more))
    rows = catalogue.QUERIES["graph_steiner_edges"](spark, str(tmp_path)).collect()
    assert asked == [6] and sorted((r.src, r.dst) for r in rows) == [(0, 100), (0, 105), (100, 1000001), (105, 2000001)]
