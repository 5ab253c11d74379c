"""Operators that answer all records at once: subgraphs, cycles, names, vector index, relaxation, first successes; and defects mended."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import ship
from quarry.functions import metrics, text
from quarry.operators import cells, chains, evidence, graph, providers, resolve, retrieval, tagging

# ---- connecting subgraphs ---------------------------------------------------------------------------------------------


def walk(edges, start):
    seen, ring = {start: 0}, [start]
    while ring:
        nxt = []
        for u in ring:
            for v in edges[u]:
                if v not in seen:
                    seen[v] = seen[u] + 1
                    nxt.append(v)
        ring = nxt
    return seen


def test_connecting_sets_are_as_light_as_the_closures_tree(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102)]
    both = defaultdict(set)
    for a, b in pairs:
        both[a].add(b)
        both[b].add(a)
    records = {k: rng.sample(range(60), rng.choice([1, 2, 3, 6])) for k in range(25)} | {100: [100, 102, 5, 500], None: [1, 2]}
    rows = [(k, t) for k, ts in records.items() for t in ts] + [(100, 100), (101, None)]
    edges = spark.createDataFrame(pairs, "src long, dst long").withColumn("edge_id", F.monotonically_increasing_id())
    asked = spark.createDataFrame(rows, "index int, node_id long").repartition(3)
    got = defaultdict(set)
    for r in graph.connecting_nodes(edges, asked).collect():
        got[r["index"]].add(r.node_id)
    assert set(got) == set(records)
    for k, ts in records.items():
        far = {t: walk(both, t) for t in ts}
        parts = {t: min(far[t]) for t in ts}
        weight = 0
        lead = {t: t for t in ts}
        root = lambda t: t if lead[t] == t else root(lead[t])  # noqa: B023, E731
        for d, a, b in sorted((far[a][b], a, b) for a, b in combinations(ts, 2) if b in far[a]):
            if root(a) != root(b):
                lead[root(a)] = root(b)
                weight += d
        assert got[k] >= set(ts) and len(got[k]) <= weight + len(set(parts.values()))
        inner = {u: both[u] & got[k] for u in got[k]}
        assert all((b in walk(inner, a)) == (b in far[a]) for a, b in combinations(ts, 2))
    sub = graph.connecting_subgraphs(edges, asked.where("index = 100")).collect()
    assert {(r["index"], r.src, r.dst) for r in sub if r.src >= 100} == {(100, 100, 101), (100, 101, 102)}


def test_subgraph_info_of_all_records(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1), (1, 2, 3, 1), (2, 3, 4, 2), (3, 1, 2, 2)], "edge_id long, src long, dst long, type_id int")
    docs = spark.createDataFrame([(k, f"d{k}") for k in range(1, 6)], "node_id long, doc string")
    types = spark.createDataFrame([(1, "one"), (2, "two")], "type_id int, label string")
    nodes = spark.createDataFrame([(7, 1), (7, 3), (8, 4), (9, 2), (9, 1)], "index int, node_id long")
    got = {r["index"]: r for r in chains.kg_subgraph_info(nodes, edges, docs, types).collect()}
    assert got[7].node_list == ["1", "3"] and got[7].subgraph == [0, 1, 3]
    assert got[7].info == "The retrieved subgraph contains 3 nodes and 3 edges.\n\nNodes:\n- Node ID: 1, Doc Info: d1\n- Node ID: 2, Doc Info: d2\n- Node ID: 3, Doc Info: d3\n\nConnections:\n- Node ID 1 is connected to Node ID 2 with edge type: one\n- Node ID 2 is connected to Node ID 3 with edge type: one\n- Node ID 1 is connected to Node ID 2 with edge type: two"
    assert got[8].subgraph == [] and got[8].info == "The retrieved subgraph contains 0 nodes and 0 edges.\n\nNodes:\n\nConnections:"
    first = {r["index"]: r.info for r in chains.kg_subgraph_info(nodes, edges, docs, types, most=1).collect()}
    assert first[9].count("is connected") == 1 and "2 nodes and 1 edges" in first[9]


def test_acyclic_of_many_graphs(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(6), rng.randrange(6)) for g in range(60) for _ in range(rng.randrange(1, 6))]
    rows += [(100, k, k + 1) for k in range(15)] + [(101, 1, None), (102, 5, 5), (103, 1, 2), (103, 1, 2), (103, 2, 1)]

    def cyclic(pairs):
        out = defaultdict(set)
        for a, b in pairs:
            out[a].add(b)
        return any(a in {w for v in out[a] for w in walk(out, v)} for a in list(out))

    of = defaultdict(list)
    for g, a, b in rows:
        of[g].append((a, b))
    got = {r.g: r.dag for r in graph.acyclic(spark.createDataFrame(rows, "g int, src int, dst int"), ["g"]).collect()}
    assert got == {g: 0 if cyclic([p for p in pairs if None not in p]) else 1 for g, pairs in of.items()}
    assert graph.acyclic(spark.createDataFrame([], "g int, src int, dst int"), ["g"]).count() == 0


# ---- names ------------------------------------------------------------------------------------------------------------

NAMES = ["EW", "ewing", "ewing sarcoma", "sarcoma cell", "cell", "β-catenin", "p53", "p53-null", "-x", "a b c", "b", "TNF (alpha)", "q."]


@pytest.mark.parametrize("most", [1000, 3])
def test_names_as_the_pattern_finds_them(spark, most):
    ship(spark)
    rng = random.Random(2)
    bits = [*NAMES, "ewing sarcoma cell line", "x", " ", "-", "p53-nullx", "EWS", "a b", ". ", "é", "\n", "(", "ab c"]
    texts = [(k, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 25)))) for k in range(80)] + [(900, None), (901, "")]
    names = [(n, f"T{len(n)}") for n in NAMES] + [("cell", "A"), (None, "x"), ("", "y")]
    got = defaultdict(list)
    for r in tagging.tag_names(spark.createDataFrame(texts, "id int, text string").withColumn("tag", F.lit(1)), "id", "text", spark.createDataFrame(names, "name string, tag string"), most).collect():
        got[r.id].append((r.start, r.end, r.entity, r.tag))
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(t)}(?!\w)" for t in sorted(NAMES, key=lambda t: (-len(t), t))))
    for k, text in texts:
        assert sorted(got[k]) == [(m.start(), m.end(), m.group(), f"T{len(m.group())}") for m in pattern.finditer(text or "")], (k, text)
    assert tagging.tag_names(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([], "name string, tag string")).count() == 0


# ---- vectors ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_the_index_finds_k_and_nearly_all_neighbours(spark, monkeypatch, metric):
    ship(spark)
    for name, value in (("CELL_ROWS", 40), ("BLOCK", 50), ("ASKING", 20)):
        monkeypatch.setattr(cells, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(12, size=1200)]
    x[1190:] = 0.05 * rng.normal(size=(10, 8)) - 20  # a small far cluster
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, [0.0] * 8), (2001, [1.0, 2.0]), (2002, None), (2003, [float("nan")] * 8), (2004, [])]
    nodes = spark.createDataFrame(rows, "node_id int, embedding array<double>").withColumn("cell", F.lit("clash"))
    index = cells.build(nodes, metric)
    asked = spark.createDataFrame([(f"q{k}", x[k].tolist()) for k in (*range(0, 1190, 12), *range(1190, 1200))] + [("two", [1.0, 2.0]), ("none", None), ("three", [1.0] * 3)], "query_id string, embedding array<double>")
    got = defaultdict(list)
    for r in cells.search(index, asked, 15).collect():
        got[r.query_id].append((r["rank"], r.node_id, r.score))
    assert len(index.centres) > 5 and {q: len(v) for q, v in got.items()} == {f"q{k}": 15 for k in (*range(0, 1190, 12), *range(1190, 1200))} | {"two": 1}
    hits = total = 0
    for q, found in got.items():
        if q != "two":
            y = x[int(q[1:])]
            s = {"dot": x @ y, "cosine": x @ y / np.linalg.norm(x, axis=1) / np.linalg.norm(y), "l2": 1 / (1 + np.linalg.norm(x - y, axis=1))}[metric]
            hits, total = hits + len({n for _, n, _ in found} & set(np.argsort(-s)[:15].tolist())), total + 15
            assert all(z == pytest.approx(s[n]) for _, n, z in found if n < 1200)
    assert hits / total >= 0.9
    empty = cells.build(nodes.limit(0), metric)
    assert cells.search(empty, asked, 3).count() == 0
    with pytest.raises(ValueError, match="metric"):
        cells.build(nodes, "other")


def test_papers_near_a_query(spark):
    ship(spark)
    corpus = spark.createDataFrame([(k, f"t{k}", None if k % 3 == 0 else "Abstract not found" if k % 3 == 1 else f"a{k}", [float(k), 1.0]) for k in range(1, 40)], "node_id long, title string, abstract string, embedding array<double>")
    encoder = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    queries = spark.createDataFrame([(1, "x" * 5), (2, "x" * 5), (3, "x" * 11), (4, None)], "index int, query string")
    got = {r["index"]: [p.title for p in r.papers] for r in chains.nearest_paper_list(queries, corpus, encoder, most=2, spare=6).collect()}
    order = lambda n: sorted(range(1, 40), key=lambda k: -(k * n + 1) / np.hypot(k, 1) / np.hypot(n, 1))[:8]
    want = lambda n: [f"t{k}" for k in order(n) if k % 3 == 2][:2]
    assert got == {1: want(5), 2: want(5), 3: want(11)}


def test_passages_and_answers(spark):
    ship(spark)
    rng = random.Random(9)
    word = lambda: f"t{int(rng.paretovariate(0.7)) % 60}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(200)] + [(900, None), (901, " ,"), (None, "t1")]
    questions = [(k, " ".join(word() for _ in range(rng.randrange(1, 12)))) for k in range(25)] + [(90, None), (91, "nowhere"), (92, "T1 t1")]
    held = {k: t.split() for k, t in docs if k is not None and t and t.strip(" ,")}
    mean = sum(map(len, held.values())) / len(held)
    df = {w: sum(w in t for t in held.values()) for t in held.values() for w in t}

    def score(q, t):
        return sum(int(int(1e6 * np.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))) * (t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)))) for w in q if w in t)

    frame = spark.createDataFrame(docs, "doc_id int, text string").withColumn("n", F.lit("clash"))
    asked = spark.createDataFrame(questions, "index int, question string")
    got = defaultdict(list)
    for r in retrieval.best_passages(asked, frame, 5).orderBy("index", "rank").collect():
        got[r["index"]].append((r.doc_id, r.score))
    want = {}
    for k, q in questions:
        q = (q or "").lower().split()
        top = sorted((-score(q, t), d) for d, t in held.items() if set(q) & set(t))[:5]
        if top:
            want[k] = [(d, -s) for s, d in top]
    assert {k: [d for d, _ in v] for k, v in got.items()} == {k: [d for d, _ in v] for k, v in want.items()}
    assert all(abs(a - b) <= 3 for k in want for (_, a), (_, b) in zip(got[k], want[k], strict=True))
    told = {r["index"]: r for r in retrieval.answers(asked.where("index in (0, 90, 91)"), frame, lambda: lambda prompts: [p[-3:] for p in prompts], 2).collect()}
    assert told[0].passages == [d for d, _ in want[0][:2]] and told[0].answer == questions[0][1][-3:] and told[91].passages is None and told[90].answer is None


def test_bleu_of_a_table_is_the_plain_one(spark):
    rng = random.Random(12)
    bits = ["a", "b", "b.", "3,5", "x-y", "9-z", "(c)", "&quot;q&quot;", "é", "d-\n", "\n", "<skipped>", "$1"]
    line = lambda: " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
    rows = [(k, line(), line()) for k in range(40)] + [(k, line(), line()) for k in range(0, 40, 2)] + [(90, None, "a"), (91, "a b", None), (None, "a b c", "a b c")]
    df = spark.createDataFrame(rows, "k int, t string, f string").withColumn("n", F.lit("clash")).repartition(3)
    got = {r.k: r.bleu for r in metrics.bleu_table(df, ["k"], "t", "f").collect()}
    assert set(got) == {k for k, *_ in rows}
    for k, bleu in got.items():
        parts = [(t or "", f or "") for key, t, f in rows if key == k]
        assert bleu == pytest.approx(text.corpus_bleu([f for _, f in parts], [t for t, _ in parts]), abs=1e-9), (k, parts)


def test_bleu_moves_counts_not_ngrams(spark):
    """What is shuffled of a long text is a row of counts, however many n-grams it has."""
    df = spark.createDataFrame([(1, "a b c d " * 5000, "b c d e " * 5000), (1, "a b", "a c")], "k int, t string, f string")
    found = metrics.bleu_table(df, ["k"], "t", "f")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
    pairs = [("a b c d " * 5000, "b c d e " * 5000), ("a b", "a c")]
    assert found.first().bleu == pytest.approx(text.corpus_bleu([f for _, f in pairs], [t for t, _ in pairs]), abs=1e-9)


# ---- relaxation and first successes ---------------------------------------------------------------------------------------


def test_relaxation_of_each_record(spark):
    rng = random.Random(7)
    docs = {k: {rng.choice("abcdefg") for _ in range(rng.randrange(0, 6))} for k in range(120)}
    queries = {k: rng.sample("abcdefgz", rng.randrange(1, 5)) for k in range(20)}

    def plain(terms, enough):
        found, names = [], list(terms)
        while names and len(found) < enough:
            found += [(len(terms) - len(names), d) for d in sorted(docs) if set(names) <= docs[d] and d not in {x for _, x in found}]
            names.pop()
        return found[:enough]

    asked = spark.createDataFrame([(k, p, t) for k, ts in queries.items() for p, t in enumerate(ts)] + [(0, 0, queries[0][0]), (99, 0, None)], "index int, pos int, term string")
    postings = spark.createDataFrame([(t, d) for d, ts in docs.items() for t in ts] * 2 + [("a", None)], "term string, doc_id int")
    got = defaultdict(list)
    for r in evidence.relax_each(asked, postings, 7).orderBy("index", "place").collect():
        got[r["index"]].append((r.round, r.doc_id))
    assert dict(got) == {k: plain(ts, 7) for k, ts in queries.items() if plain(ts, 7)}
    papers = spark.createDataFrame([(d, f"t{d}", f"a{d}" if d % 2 else None) for d in docs], "doc_id int, title string, abstract string")
    lists = {r["index"]: [p.title for p in r.papers] for r in chains.paper_list(asked.withColumnRenamed("term", "entity"), postings, papers, 7).collect()}
    assert lists == {k: w for k, ts in queries.items() if (w := [f"t{d}" for _, d in plain(ts, 7) if d % 2])}


def test_first_success_asks_no_further(spark, tmp_path):
    records = spark.createDataFrame([(1, "bad good never1"), (2, "good never2"), (3, " bad  worse "), (4, None), (5, "broken good never3")], "index int, disease_model string")
    log = str(tmp_path / "log")

    def service():
        def reply(words):
            with open(log, "a") as f:
                f.writelines(w + "\n" for w in words)
            if "broken" in words:
                raise RuntimeError("down")
            return ['{"status":"error"}' if w in ("bad", "worse") else '{"name":"set"}' for w in words]

        return reply

    ok = lambda r: F.get_json_object(r, "$.status").isNull()
    found = providers.first_success(chains.words(records, "disease_model"), service, ok)
    assert {(r["index"], r.pos, r.word) for r in found.collect()} == {(1, 1, "good"), (2, 0, "good"), (5, 1, "good")}
    assert not {"never1", "never2", "never3"} & set(open(log).read().split())
    sets = spark.createDataFrame([("good", "text of it")], "name string, text string")
    got = {r["index"]: r.info for r in chains.disease_model_evidence(records, found, sets).collect()}
    assert set(got) == {1, 2, 5} and got[2] == "### DISEASE MODEL INFORMATION\nThe disease model of the context is good never2. text of it"


# ---- defects mended ---------------------------------------------------------------------------------------------------------


def test_dedupe_keeps_rows_of_null_and_equal_positions(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, "d"), (None, "a")], "pos int, x string")
    assert sorted((r.x, r.pos) for r in resolve.dedupe(rows, "pos").collect()) == [("a", 1), ("b", 1), ("c", None), ("d", 3)]
    assert {r.x: r.pos for r in resolve.dedupe(rows, "pos", "last").collect()} == {"a": None, "b": 1, "c": None, "d": 3}
    twice = spark.createDataFrame([(1, 5, "a"), (1, 6, "a"), (1, 5, "a")], "pos int, index int, x string")
    assert resolve.dedupe(twice, "pos").count() == 1
    with pytest.raises(ValueError, match="keep"):
        resolve.dedupe(rows, "pos", "any")


def test_dedupe_without_the_ignored_fields(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"pos":1,"index":4,"a":{"index":1,"x":[{"index":2,"y":3}]}}', '{"pos":2,"index":5,"a":{"index":9,"x":[{"index":7,"y":3}]}}']))
    got = resolve.dedupe(rows, "pos", drop_ignored=True)
    assert got.columns == ["a", "pos"] and got.collect()[0].asDict(recursive=True) == {"pos": 1, "a": {"x": [{"y": 3}]}}


def test_no_lookups_match_nothing(spark):
    mentions = spark.createDataFrame([("a", "T"), ("a", None), (None, "T")], "entity string, tag string")
    assert {tuple(r) for r in resolve.resolve(mentions, []).collect()} == {("a", "T", None, None), ("a", None, None, None), (None, "T", None, None)}
    one = resolve.candidate(spark.createDataFrame([("a", 7)], "n string, i long"), F.col("n"), F.col("i"), 1, "T")
    assert {tuple(r) for r in resolve.resolve(mentions, [one]).collect()} == {("a", "T", 7, 1), ("a", None, None, None), (None, "T", None, None)}


def test_a_provider_that_cannot_be_made_fails_rows_only(spark):
    def make():
        raise OSError("no key")

    got = providers.call_once(spark.createDataFrame([("x",), ("y",)], "q string"), "q", make).collect()
    assert len(got) == 2 and all(r.reply is None and "no key" in r.error for r in got)


def test_edge_ids_of_repeated_and_missing_pairs(spark):
    edges = spark.createDataFrame([(5, 1, 2), (4, 1, 2), (6, 2, 1)], "edge_id long, src long, dst long")
    got = resolve.edge_ids(edges, spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 4, 2), (3, 3, -1, 0)} and got.count() == 2


def test_subgraphs_do_not_walk_a_hubs_leaves(spark, monkeypatch):
    """Records that hang on one hub of many leaves: what is stored grows with the records, not with records times leaves."""
    edges = spark.range(2000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")).withColumn("edge_id", F.col("dst"))
    records = spark.range(40).select("id", F.explode(F.array(F.col("id"), F.col("id") + 100, F.lit(-1).cast("long"))).alias("node_id")).withColumnRenamed("id", "index")
    sizes, plain = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    got = sorted((r["index"], r.edge_id) for r in graph.connecting_subgraphs(edges, records).collect())
    assert got == sorted((k, k + d) for k in range(40) for d in (0, 100))
    assert max(sizes) <= 2 * 2000


def test_edges_of_a_hot_pair_are_counted_before_they_move(spark):
    """One pair with very many parallel edges: nothing is sorted or joined, and odd pairs are as by a left join."""
    edges = spark.range(5000).select(F.lit(1).alias("src"), F.lit(2).alias("dst"), F.col("id").alias("edge_id")).union(spark.createDataFrame([(3, 4, 7), (None, 4, 8)], "src int, dst int, edge_id long"))
    wanted = spark.createDataFrame([(1, 2), (1, 2), (5, 6), (None, 4)], "src int, dst int")
    found = resolve.edge_ids(edges, wanted)
    assert sorted((str(r.src), r.dst, r.edge_id, r.n) for r in found.collect()) == [("1", 2, 0, 5000), ("5", 6, -1, 0), ("None", 4, -1, 0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """Graphs of a few edges go by in one pass, however long their chains; larger ones still by rounds, with the same results."""
    chain = [(1, k, k + 1) for k in range(12)]
    rows = [*chain, *((2, a, b) for _, a, b in chain), (2, 12, 0), (3, 5, 5), (4, None, 1), (5, 1, 2), (5, 1, 2)]
    want = {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    df = spark.createDataFrame(rows, "k int, src int, dst int")
    with monkeypatch.context() as patch:
        patch.setattr(graph, "SMALL", 4)
        assert {r.k: r.dag for r in graph.acyclic(df, ["k"]).collect()} == want
    monkeypatch.setattr(graph, "core", None)
    assert {r.k: r.dag for r in graph.acyclic(df, ["k"]).collect()} == want


def test_passages_of_many_shards_and_blocks(spark, monkeypatch):
    """Shards of few postings and blocks of few questions give what plain adding gives; an id of two texts adds up, equal scores go by id."""
    monkeypatch.setattr(retrieval, "SHARD", 7)
    monkeypatch.setattr(retrieval, "ASKED", 3)
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 3 + i % 5))) for i in range(40)] + [(3, "w1 w1 w2 Zoë"), (None, "w1"), (50, None), (51, "...")]
    passages = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q % 7} W{(q + 2) % 7} w{q % 7} zoë") for q in range(9)] + [(90, "nothing"), (91, None)], "index long, question string")
    words = asked.select("index", F.explode(retrieval.terms(F.col("question"))).alias("term")).groupBy("index", "term").agg(F.count("*").alias("times"))
    plain = {}
    for r in words.join(retrieval.postings(passages, words), "term").collect():
        plain.setdefault(r["index"], {}).setdefault(r.doc_id, []).append(r.times * r.impact)
    want = {(q, d, s, n + 1) for q, found in plain.items() for n, (s, d) in enumerate(sorted(((sum(v), d) for d, v in found.items()), key=lambda x: (-x[0], x[1]))[:4])}
    assert {(r["index"], r.doc_id, r.score, r["rank"]) for r in retrieval.best_passages(asked, passages, 4).collect()} == want


def test_texts_are_walked_once_however_many_names_there_are(spark):
    """Rows that share an id keep their own places, also with more names than one filter is made for."""
    names = [(f"Name#{i:09d}", "N") for i in range(3000)] + [("red", "C"), ("red 7", "C")]
    texts = [(1, "x Name#000000007 red 7"), (1, "Name#000000007 red 8 Name#0000000071"), (2, None), (3, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    for most in (tagging.NAMES, 10):
        found = tagging.tag_names(df, "id", "text", spark.createDataFrame(names, "name string, tag string"), most)
        assert sorted((r.id, r.start, r.end, r.entity) for r in found.collect()) == [(1, 0, 14, "Name#000000007"), (1, 2, 16, "Name#000000007"), (1, 15, 18, "red"), (1, 17, 22, "red 7")]
