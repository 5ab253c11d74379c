"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import os
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, importance, langid, line_dedup, mixing, ngram_join, packing, pitman_yor, quality_rules, token_files
from quarry.llm.common import Slots, buffers, doc_fold, ranked, runs, words

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BPE = public.path("word_bpe_49k.json")
TABLES = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns, some with names that operators use themselves
EXTRA = "score double, kept boolean, size long, n_lines long, target double, node binary"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


ENGLISH = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions for hungry trolls near old bridges"
FRENCH = "le renard brun saute par dessus le chien paresseux pendant que les sorciers préparent des potions étranges près du pont"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


def texts():
    base = ENGLISH.split()
    rows = [(k, " ".join(base[k % 7 :] + [f"tail{k}"] * 3) + f"\nline number {k}\nshared boiler plate line of more than ten words in all documents here", "en", "a") for k in range(12)]
    rows += [(100 + k, " ".join(FRENCH.split()[k % 5 :]) + f" fin{k}", "fr", "b") for k in range(8)]
    rows += [(200, rows[0][1], "en", "a"), (201, rows[0][1] + " extra", "en", "a"), (300, LONG, "en", None), (301, LONG + " end", "en", None)]
    rows += [(400, None, "en", "a"), (401, "", None, "b"), (402, " \t\n ", "fr", None), (403, "12 34 ### !!", None, ""), (404, "x", "en", "c"), (405, "é", None, "c"), (406, "a b c d", "en", "c"), (407, "A B\nC D", None, "c"), (408, "<|endoftext|> don't I'LL x<|startoftext|>y ﬁ  \x1c é́", None, "d")]
    rows += [(None, "a null id with several words in it", "en", "a"), (None, None, None, None), (7, rows[7][1], "en", "a"), (7, "another text under the same id as before", "en", "a")]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(odd):
    extra = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")]
    return odd.select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 1, 1), (100, 0, 0), (101, 0, 1), (102, None, None), (None, 1, 0), (9999, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "join": lambda d, _: ngram_join.near_duplicates(d),
    "pack": lambda d, _: packing.pack(d),
    "lines": lambda d, _: line_dedup.clean(d.select("doc_id", "text")),
    "mix": lambda d, _: mixing.mix(d),
    "tokens": lambda d, _: token_files.round_trip(d, BPE),
    "importance": lambda d, n: importance.resample(d, n),
    "language": lambda d, _: langid.identify(d, steps=5),
    "lm": lambda d, _: pitman_yor.score(d),
    "rules": lambda d, n: quality_rules.judge(d, n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, clashing, labels, name):
    run = OPERATORS[name]
    rows = sorted(map(str, run(odd, labels).collect()))
    assert len(rows) >= odd.count()
    if name != "pack":
        assert len(rows) == odd.count()
    assert sorted(map(str, run(clashing, labels).collect())) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(empty, labels, name):
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [lambda d: langid.identify(d, accept=0.35, steps=5), line_dedup.dedup, ngram_join.one_of_each, mixing.take])
def test_filters_keep_columns(odd, clashing, empty, stage):
    assert stage(clashing).columns == clashing.columns
    assert stage(clashing).count() == stage(odd).count() > 5
    assert stage(empty).count() == 0


# ---- shared kernels -----------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    sample = [t for _, t, *_ in texts()]
    data, at = buffers(pa.array(sample))
    for i, j in runs(at, 5000):
        part, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
        h, head, end, first = words(part, edge, lower=True)
        got = [[bytes(part[a:b]) for a, b in zip(head[first[k] : first[k + 1]], end[first[k] : first[k + 1]])] for k in range(j - i)]
        assert got == [[w.encode() for w in WORD.findall(t or "")] for t in sample[i:j]]
        seen = defaultdict(set)
        for k, w in zip(h.tolist(), (w for row in got for w in row)):
            seen[lower(w.decode())].add(k)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_words_of_long_texts():
    """Over the piece that the kernel handles at once, words across its edges too."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("ab é\n\t日x"), 900_000).tolist()) + "y" * 1_200_000 + " end"
    data, at = buffers(pa.array([long, "", None, "z " * 700_000]))
    h, head, end, first = words(data, at)
    want = [[w.encode() for w in WORD.findall(t)] for t in (long, "", "", "z " * 700_000)]
    raw = data.tobytes()
    assert [[raw[a:b] for a, b in zip(head[x:y].tolist(), end[x:y].tolist())] for x, y in zip(first[:-1], first[1:])] == want
    same = defaultdict(set)
    for k, w in zip(h.tolist(), (w for row in want for w in row)):
        same[w].add(k)
    assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)


def test_slots():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    slots = Slots()
    slots.add(keys[:3000], np.arange(3000))
    slots.add(keys[3000:], np.arange(3000, len(keys)))
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_ranked(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 17)
    got = [r._rank for r in ranked(df, F.col("v").desc(), F.col("id")).orderBy(F.col("v").desc(), "id").collect()]
    assert got == list(range(1000))


# ---- 1 ------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, similarity=0.8):
    """Class and links of rows (id, text) with ids, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    lead, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            lead[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, least[root(k)], links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("item", [ngram_join.ITEM_SHINGLES, 60])  # the second splits components into pairs of blocks
def test_join_is_exact(spark, odd, item):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(300)]
    rows = []
    for base in range(12):
        text = rng.choice(vocabulary, 60).tolist()
        for _ in range(int(rng.integers(1, 9))):
            edited = list(text)
            edited[int(rng.integers(60))] = "edit"
            rows.append((1000 + len(rows), " ".join(edited if rng.random() < 0.7 else text)))
    rows += [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df, item=item).collect())
    assert got == jaccard_classes(rows)


def test_prefixes_reach_recall():
    lengths = ngram_join.prefixes()
    assert lengths[0] == ngram_join.DEPTH and lengths == sorted(lengths, reverse=True)
    assert ngram_join.met(0.8, lengths[-1]) >= ngram_join.RECALL > ngram_join.met(0.8, lengths[-1] + 1)


def test_neighbours_are_those_of_the_sorted_tries(spark):
    rng = np.random.default_rng(12)
    nodes = [(bytes([k, 1]), rng.integers(0, 3, 4 * ngram_join.DEPTH).astype(">u2").tobytes()) for k in range(60)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in nodes], "node binary, labels binary").repartition(5)
    got = Counter((bytes(r.a), bytes(r.b), r.shared) for r in ngram_join.neighbours(df, 2, trees=4).collect())
    want, width = Counter(), 2 * ngram_join.DEPTH
    for t in range(4):
        order = sorted((b[t * width : (t + 1) * width], a) for a, b in nodes)
        for (x, a), (y, b) in zip(order, order[1:]):
            n = next((k for k in range(ngram_join.DEPTH) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), ngram_join.DEPTH)
            if n >= 2:
                want[b, a, n] += 1
    assert got == want


def test_recall_near_the_threshold(spark):
    """Links of pairs, and inside groups, that are barely similar enough."""
    rng = np.random.default_rng(3)
    rows = []
    for group in range(150):
        base = [f"g{group}w{k}" for k in range(120)]
        for c in range(2 if group % 3 else 5):
            text = list(base)
            for at in rng.choice(24, int(rng.integers(0, 3)), replace=False):
                text[5 * int(at)] = f"edit{c}"
            rows.append((len(rows), " ".join(text)))
    want = jaccard_classes(rows)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    true = sum(n for *_, n in want.elements())
    assert true > 500
    found = {i: n for i, _, n in got.elements()}
    assert sum(min(found[i], n) for i, _, n in want.elements()) >= 0.99 * true
    assert all(found[i] <= n for i, _, n in want.elements())


def test_one_of_near_copies_that_share_an_id_stays(spark):
    text = [f"word{k}" for k in range(60)]
    rows = [(1, " ".join(text), 5), (1, " ".join([*text, "more"]), 6), (2, " ".join(text), 7), (2, "something else", 8), (2, "something else", 8), (None, " ".join(text), 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)[:9]) for r in got.collect()) == [("1", "word0 wor"), ("2", "something"), ("None", "None"), ("None", "word0 wor")]


def test_near_copies_that_lost_lines_are_one_document(spark):
    """What is left of two near copies after their shared lines went doesn't look alike; their texts as they came do."""
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    whole = [line(k) for k in range(20)]
    came = [(1, "\n".join(whole)), (2, "\n".join([*whole[:19], line(50)])), (3, line(70)), (4, line(80)), (4, line(81)), (5, line(90))]
    now = [(1, "\n".join(whole)), (2, line(50)), (3, line(70)), (4, line(80)), (5, line(91)), (None, line(50))]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("comp", F.lit(1))
    got = ngram_join.one_of_each(make(now), before=make(came))
    assert got.columns == ["doc_id", "text", "comp"] and sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "3", "4", "5", "None"]
    assert ngram_join.one_of_each(make(now)).count() == 6


def test_components(spark):
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in [(1, 2), (2, 3), (4, 3), (7, 9), (9, 8), (5, 5)] + [(k, k + 1) for k in range(20, 60)]], "a binary, b binary")
    got = {r.node[0]: r.comp[0] for r in ngram_join.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 61)}


# ---- 2 ------------------------------------------------------------------------------------------------------------------


def test_packing_fits_and_covers(spark, odd):
    lengths = (8, 16, 64)
    rows = [r.asDict() for r in packing.pack(odd, lengths).collect()]
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t, *_ in texts():
        want[i] += len(WORD.findall(t or ""))
    assert +total == +want
    bins = defaultdict(list)
    for r in rows:
        if r["bin"] is None:
            assert r["n_tokens"] == 0
        else:
            bins[r["bin"]].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r["position"])
        used = 0
        for r in content:
            assert r["position"] == used
            used += r["n_tokens"]
        assert {r["capacity"] for r in content} == {min(c for c in lengths if c >= used)}


def test_best_fit_against_a_plain_packer():
    """The kernel against the rule written plainly, at the shipped lengths."""
    rng = np.random.default_rng(0)
    for lengths, top in ((packing.LENGTHS, 4000), (packing.LENGTHS, 700), ((16, 64), 60)):
        sizes = sorted(rng.integers(1, top, 400).tolist(), reverse=True)
        bins, offsets, caps, opened = packing.best_fit(sizes, lengths)
        room, want = {}, []
        for k, n in enumerate(sizes):
            fits = [(r, -b) for b, r in room.items() if r >= n]
            if fits:
                assert room[bins[k]] == min(fits)[0]
            else:
                choice = []
                for c in lengths:
                    if c >= n:
                        full = n + min(c - n, sum(x for x in sizes[k + 1 :] if x <= c - n))
                        choice.append((packing.cost(min(x for x in lengths if x >= full)) / full, c))
                assert bins[k] not in room
                room[bins[k]] = opened[bins[k]]
                assert packing.cost(opened[bins[k]]) and min(choice)[0] == pytest.approx(next(p for p, c in choice if c == opened[bins[k]]))
            room[bins[k]] -= n
        used = Counter()
        for n, b, at in zip(sizes, bins, offsets):
            assert used[b] == at
            used[b] += n
        assert [min(c for c in lengths if c >= used[b]) for b in range(len(caps))] == caps


def test_lengths_are_chosen_jointly_and_bins_shrink():
    """At the shipped lengths some bin opens longer than its first piece needs, some shrinks, and no single way of opening is cheaper."""
    rng = np.random.default_rng(1)
    sizes = sorted(np.minimum(8192, rng.lognormal(5.3, 1.1, 5000).astype(int) + 1).tolist(), reverse=True)
    bins, _, caps, opened = packing.best_fit(sizes)
    first = {b: n for n, b in reversed(list(zip(sizes, bins)))}
    assert any(opened[b] > min(c for c in packing.LENGTHS if c >= n) for b, n in first.items())
    assert any(c < o for c, o in zip(caps, opened)) and len(set(opened)) > 3
    total = sum(map(packing.cost, caps))
    for alone in packing.LENGTHS:
        one = [alone] + [c for c in packing.LENGTHS if c > alone]
        assert total <= 1.01 * sum(map(packing.cost, packing.best_fit(sizes, one[:1])[2])) if alone >= sizes[0] else True
    assert sum(sizes) / sum(caps) > 0.97


# ---- 3 ------------------------------------------------------------------------------------------------------------------


def plain_lines(docs, least=line_dedup.MIN_WORDS, words_=line_dedup.COMMON_WORDS, places=line_dedup.COMMON_PLACES):
    """Texts of {id: lines} without the lines of runs of enough words that occurred before; runs of all lengths."""
    heads = {d: [k for k, x in enumerate(lines) if WORD.search(x)] for d, lines in docs.items()}
    count = Counter(docs[d][k] for d in docs for k in heads[d])
    first, gone = {}, defaultdict(set)
    for d in sorted(docs):
        at = heads[d]
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                run = tuple(docs[d][k] for k in at[i:j])
                first.setdefault(run, (d, i))
                n = sum(len(WORD.findall(x)) for x in run)
                if first[run] < (d, i) and (n >= least or j == i + 1 and n >= words_ and count[run[0]] >= places):
                    for k in range(i, j):
                        gone[d] |= set(range(at[k], at[k + 1] if k + 1 < len(at) else len(docs[d])))
    return {d: "\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, lines in docs.items()}


@pytest.mark.parametrize(("least", "words_", "places"), [(1, 1, 1), (10, 2, 9), (25, 9, 9)])
def test_lines_against_brute_force(spark, least, words_, places):
    rng = np.random.default_rng(least)
    docs = {k: [" ".join(["w"] * int(rng.integers(0, 6))) + str(rng.integers(4)) if rng.random() < 0.8 else " " for _ in range(int(rng.integers(1, 14)))] for k in range(25)}
    docs |= {30: docs[3] + docs[4], 31: docs[5], 32: docs[5], 33: ["", *docs[7][2:]], 34: ["", "x 1", "", "x 1"]}
    docs[35] = docs[30] + docs[30]
    want = plain_lines(docs, least, words_, places)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.clean(df, least, words_, places).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert {d: r.n_lines for d, r in got.items()} == {d: sum(bool(WORD.search(x)) for x in lines) for d, lines in docs.items()}
    assert all(r.n_lines - r.n_removed == sum(bool(WORD.search(x)) for x in want[d].split("\n")) for d, r in got.items())


def test_hot_lines_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_PLACES", 5)
    monkeypatch.setattr(line_dedup, "HOT", 4)
    docs = {k: [f"a line of its own in document {k} and no other one of them", "the same long line that stands in all of the documents here", "short one", f"end {k}"] for k in range(30)}
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.clean(df).collect()} == plain_lines(docs)


def test_remnants_go_and_columns_stay(spark):
    body = [f"line number {k} of a text that has quite a few words" for k in range(8)]
    docs = [(1, "\n".join(body), 77, "x"), (2, "\n".join([*body[:7], "edited"]), 78, "y"), (3, "\n".join([body[2], *[f"some other words {k} that nobody wrote before" for k in range(3)]]), 79, "z"), (4, "\n".join(body), 80, "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_lines long, _sum string")
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert sorted(got) == [1, 3]  # 2 is left with a word, 4 with none
    assert got[1].asDict() == df.where("doc_id = 1").first().asDict()
    assert (got[3].n_lines, got[3]["_sum"]) == (79, "z") and body[2] not in got[3].text


# ---- 4 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("packet", [3])
def test_mixing(spark, odd, monkeypatch, packet):
    monkeypatch.setattr(mixing, "PACKET", packet)
    got = mixing.mix(odd).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    per = defaultdict(list)
    for r in got:
        per[r.source].append(r)
    total = sum(r["size"] for r in got)
    assert sum(rows[0].target for rows in per.values()) == pytest.approx(1.5 * total)
    assert sum(r.taken for r in got) == math.floor(1.5 * total)
    for rows in per.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= packet
        assert rows[0].target <= 2 * rows[0].source_size
    order = sorted(per, key=lambda s: (s is None, s))
    free = [rows[0].target / (5, 2, 1)[order.index(s) % 3] for s, rows in per.items() if rows[0].target < 2 * rows[0].source_size - 1e-6]
    assert max(free, default=0) == pytest.approx(min(free, default=0))
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, got))


def test_the_mix_is_the_order_up_to_the_cut(spark, odd):
    """taken against serving the packets one by one in the order of virtual finish times."""
    queued = mixing.queue(odd.select("doc_id", "source", "text"))
    rows = queued.collect()
    packets = []
    for k, r in enumerate(rows):
        for turn in range(mixing.MOST):
            for at in range(0, r["size"], mixing.PACKET):
                words_ = min(mixing.PACKET, r["size"] - at)
                end = turn * r.source_size + r.before + at + words_
                packets.append((end / r.target, r.sid, end, words_, k))
    left, want = math.floor(mixing.SHARE * sum(r["size"] for r in rows)), Counter()
    for *_, words_, k in sorted(packets):
        want[k] += min(words_, left)
        left -= min(words_, left)
    got = Counter((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(odd).collect())
    assert got == Counter((r.doc_id, r.source, r["size"], want[k]) for k, r in enumerate(rows))
    plan = [(r.virtual_finish, r.sid, r.end, r.words) for r in mixing.schedule(queued).orderBy("_id").collect()]
    assert plan == [p[:4] for p in sorted(packets)]


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(k, f"word {k} and more", "s", 5, k) for k in range(6)], "doc_id long, text string, source string, _hash long, _sum long")
    got = mixing.take(docs).collect()
    assert {(r["_hash"], r["_sum"]) for r in got} == {(5, k) for k in range(6)}


def test_taken_documents_have_the_words(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(5 + k)), "en", "ab"[k % 2], 0) for k in range(20)], SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixing.take(docs).collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == +Counter(taken)


def test_rows_that_share_an_id_are_taken_by_their_texts(spark):
    rows = [(1, "a b c", "en", "x", 0), (1, "d e f", "en", "x", 0), (1, "d e f", "en", "x", 0), (None, "g h", "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = Counter()
    for r in mixing.mix(docs, weights=(1,), share=2.0).collect():
        taken[r.doc_id] += r.taken
    got = Counter(r.text for r in mixing.take(docs, weights=(1,), share=2.0).collect())
    assert taken == {1: 18, None: 4} and got == {"a b c": 2, "d e f": 4, "g h": 2}


# ---- 5 ------------------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark, odd):
    tokenizer = tokenizers.Tokenizer.from_file(BPE)
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, "" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()))
    start, want = 0, []
    for i, t in rows:
        t = t or ""
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.round_trip(odd, BPE).orderBy("start").collect()]
    assert got == want


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 9000], list(range(0, 100_000, 37))])
def test_elias_fano(values):
    coded = token_files.EliasFano.encode(np.array(values, np.uint64))
    back, rest = token_files.EliasFano.read(memoryview(coded.tobytes()))
    assert not rest and back.select(np.arange(len(values))).tolist() == values
    for i in list(range(len(values)))[:: max(1, len(values) // 50)]:
        assert back.select(np.array([i])).tolist() == [values[i]]
    if len(values) > 1000:
        assert len(coded.tobytes()) * 8 < len(values) * (3 + math.log2(values[-1] / len(values))) + 400


# ---- 6 ------------------------------------------------------------------------------------------------------------------


def test_importance_against_plain_counting(spark, monkeypatch):
    """Weights from counts of n-grams themselves (so many buckets that few are shared), and the k largest with their noise."""
    monkeypatch.setattr(importance, "BUCKETS", 1 << 22)
    rng = np.random.default_rng(4)
    make = lambda kind, n: " ".join(f"{kind}{int(k)}" for k in rng.integers(0, 40, n))
    docs = [(k, make("good" if k % 2 else "bad", 60), None, None, 0) for k in range(200)] + [(500, make("good", 3) + " " + make("bad", 3), None, None, 0), (501, "", None, None, 0), (502, None, None, None, 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, int(k == 7)) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(df, labels).collect()}
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:]))
    raw, good = Counter(), Counter()
    for k, t, *_ in docs:
        raw.update(grams(t))
        if k < 60 and k % 2 and k != 7:
            good.update(grams(t))
    a, b = sum(raw.values()) + importance.BUCKETS, sum(good.values()) + importance.BUCKETS
    want = {k: sum(math.log((good[g] + 1) / b) - math.log((raw[g] + 1) / a) for g in grams(t)) for k, t, *_ in docs if t}
    found = {k: r.log_weight for k, r in got.items() if r.log_weight is not None}
    assert set(found) == set(want)
    error = [abs(found[k] - want[k]) for k in want]
    assert np.quantile(error, 0.9) < 1e-6 and max(error) < 2  # a few documents have n-grams that share a bucket
    noise = {r.doc_id: r.u for r in df.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u")).collect()}
    order = sorted(want, key=lambda k: (-(found[k] - math.log(-math.log(noise[k]))), k))
    share = sum(k % 2 and k != 7 for k in range(60)) / 60
    assert {k for k, r in got.items() if r.kept} == set(order[: round(share * len(want))])
    assert all(k % 2 or k == 500 for k, r in got.items() if r.kept)


def test_gumbel_noise_samples_in_proportion(spark):
    """One of two documents of weights 3 to 1, again and again with other noise."""
    df = spark.createDataFrame([(0, "a", None, None, 0), (1, "b", None, None, 0)], SCHEMA)
    u = [tuple(r) for r in spark.range(3000).select(*[((F.pmod(F.xxhash64(F.lit(k).cast("long"), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))).alias(f"u{k}") for k in (0, 1)]).collect()]
    won = np.mean([math.log(3) - math.log(-math.log(a)) > -math.log(-math.log(b)) for a, b in u])
    assert won == pytest.approx(0.75, abs=0.03) and importance.resample(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("kept").count() == 2


# ---- 7 ------------------------------------------------------------------------------------------------------------------


def test_gradients_are_right():
    net = langid.Network(3, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (5, 4)), np.array([0, 1, 2, 1])
    weight = rng.random((5, 4))

    def loss():
        f = net._run(x, 0, [])
        b = net._run(x[::-1], 1, [])[::-1]
        p = net._softmax(f, b)
        return -(np.log(p[:, np.arange(4), y]) * weight).sum()

    grads = net.gradients(x, weight, y)
    for k in grads:
        for at in [np.unravel_index(i, grads[k].shape) for i in np.argsort(-np.abs(grads[k]).ravel())[:2]]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-2
            up = loss()
            net.p[k][at] = old - 1e-2
            down = loss()
            net.p[k][at] = old
            assert (up - down) / 2e-2 == pytest.approx(grads[k][at], rel=0.05, abs=1e-4)


def test_labels_of_both_ways_to_run_the_network():
    net, rng = langid.Network(3, hidden=6, seed=2), np.random.default_rng(1)
    x = rng.integers(32, 122, (40, 7)).astype(np.uint8)
    slow = net._softmax(net._run(x, 0, []), net._run(x[::-1], 1, [])[::-1])
    assert np.allclose(net.label(x), slow, atol=1e-4)
    own = rng.random((40, 7)) < 0.5
    assert np.allclose(net.sums(x, own), (slow * own[:, :, None]).sum(0), atol=1e-3)


def test_pooling_sees_whole_texts_and_what_stands_around_a_byte(monkeypatch):
    """Each letter byte counts once, whatever the windows; with margins as wide as the text, as the network on all of it."""
    net, rng = langid.Network(3, hidden=6, seed=2), np.random.default_rng(4)
    sample = [bytes(rng.integers(32, 123, n, dtype=np.uint8)) for n in (1, 5, 255, 256, 257, 700, 0, 3000)]
    data, at = np.frombuffer(b"".join(sample), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in sample])])
    total, number = langid.pooled(net, data, at)
    assert number.tolist() == [sum(65 <= c <= 90 or 97 <= c <= 122 for c in s) for s in sample]
    assert np.allclose(total.sum(1), number, rtol=1e-4)
    monkeypatch.setattr(langid, "MARGIN", 400)
    wide, _ = langid.pooled(net, data, at)
    for k, s in enumerate(sample):
        if len(s) < 300:
            x = np.array([32] * 400 + [langid._FOLD[c] for c in s] + [32] * 400, np.uint8)[:, None]
            p = net.label(x)[400 : 400 + len(s), 0]
            own = np.array([langid._LETTER[c] for c in s], bool)
            assert np.allclose(wide[k], p[own].sum(0), atol=0.05 + 0.01 * len(s))
    one, other = (net.label(np.frombuffer(t, np.uint8)[:, None])[-3:, 0] for t in (b"ab cd xyz", b"qq rr xyz"))
    assert not np.allclose(one, other, atol=1e-6)  # state crosses blanks


def test_language_held_out(spark):
    rng = np.random.default_rng(6)
    spell = {"aa": "ka mo ri tu sa".split(), "bb": "sch ung eit ver ein".split(), "cc": "oux eau tre ment é".split()}
    docs = [(k, " ".join("".join(rng.choice(s, 3)) for _ in range(12)), g, None, 0) for k in range(300) for g, s in [list(spell.items())[k % 3]]]
    got = langid.identify(spark.createDataFrame(docs, SCHEMA), steps=300).collect()
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_language_of_the_held_out_documents(spark):
    """The real table: documents of the fold that training never saw."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 250 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.98


def test_language_undetermined(odd):
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, steps=5).collect()}
    assert all(got[k] == "und" for k in (400, 401, 402, 403)) and got[405] != "und" and got[404] != "und"


# ---- 8 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("top", "part"), [(40, 5000), (0, 20_000)])  # fewer frequent words, more parts
def test_lm_base_and_counts(odd, monkeypatch, top, part):
    monkeypatch.setattr(pitman_yor, "TOP", top)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", part)
    rows = [(r.doc_id, WORD.findall(lower(r.text)) + ["\0end"]) for r in odd.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(base(t), 6)) for i, t in rows)
    got = pitman_yor.score(odd).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def plain_pitman_yor(texts, d, sweeps=60, burn_in=20, seed=0):
    """P(word | word before) by a sampler that takes customer after customer up and seats it again, tables one by one."""
    rng = np.random.default_rng(seed)
    kinds = {w for t in texts for w in t}
    base = 1 / (len(kinds) + 1)
    rooms, top = defaultdict(lambda: defaultdict(list)), defaultdict(list)  # tables by restaurant and dish: customers
    strength = pitman_yor.STRENGTH

    def p_top(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (max(0, sum(top[w]) - d * len(top[w])) + (strength + d * t) * base) / (strength + n)

    def sit(where, w, new):
        weight = [c - d for c in where[w]] + [new]
        k = rng.choice(len(weight), p=np.array(weight) / sum(weight))
        if k == len(where[w]):
            where[w].append(0)
        where[w][k] += 1
        return where[w][k] == 1

    def rise(where, w):
        k = rng.choice(len(where[w]), p=np.array(where[w]) / sum(where[w]))
        where[w][k] -= 1
        if not where[w][k]:
            where[w].pop(k)
            return True
        return False

    def seat(u, w):
        room = rooms[u]
        if sit(room, w, (strength + d * sum(map(len, room.values()))) * p_top(w)):
            sit(top, w, (strength + d * sum(map(len, top.values()))) * base)

    pairs = [(u, w) for t in texts for u, w in zip(["\0end", *t], t)]
    for u, w in pairs:
        seat(u, w)
    mean, kept = defaultdict(float), 0
    for sweep in range(sweeps):
        for u, w in pairs:
            if rise(rooms[u], w):
                rise(top, w)
            seat(u, w)
        if sweep >= burn_in:
            kept += 1
            chance = {w: p_top(w) for w in kinds}
            for u in rooms:
                n, t = sum(map(sum, rooms[u].values())), sum(map(len, rooms[u].values()))
                for w in kinds:
                    mean[u, w] += (sum(rooms[u][w]) - d * len(rooms[u][w]) + (strength + d * t) * chance[w]) / (strength + n)
    return {k: v / kept for k, v in mean.items()}


@pytest.mark.parametrize(("top", "near"), [(pitman_yor.TOP, 0.06), (3, 0.3)])
def test_lm_against_a_plain_sampler(spark, monkeypatch, top, near):
    """Scores of one-word steps against averaged predictive probabilities of the customer-by-customer sampler; less near
    for words that aren't frequent, which bring the parent one customer a context."""
    monkeypatch.setattr(pitman_yor, "TOP", top)
    rng = np.random.default_rng(2)
    names = [f"w{k}" for k in range(9)]
    chain = rng.dirichlet(np.full(9, 0.4), 9)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    texts_ = []
    for _ in ids:
        walk = [int(rng.integers(9))]
        for _ in range(12):
            walk.append(int(rng.choice(9, p=chain[walk[-1]])))
        texts_.append([names[k] for k in walk])
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    asked = [names[int(a)] + " " + names[int(b)] for a, b in rng.integers(0, 9, (40, 2))]
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts_)] + list(zip(held, asked))
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    pairs = Counter(p for t in texts_ for p in zip(["\0end", *t], [*t, "\0end"]))
    ones, twos = sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values())
    want = plain_pitman_yor([[*t, "\0end"] for t in texts_], min(0.95, max(0.05, ones / max(1, ones + 2 * twos))))
    error = []
    for i, text in zip(held, asked):
        a, b = text.split()
        error.append(got[i] - sum(math.log10(want[p]) for p in (("\0end", a), (a, b), (b, "\0end"))))
    assert abs(np.mean(error)) < near and np.std(error) < 0.1 + near


def test_lm_knows_what_follows_rare_words(spark, monkeypatch):
    """Words far beyond the most frequent ones, all of one ending, have contexts of their own, looked up or joined."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    free = [i for i in range(200) if i not in held][:2]
    rows = [(i, " ".join(f"a{k}zzz b{k}zzz" for k in range(1500))) for i in free]
    rows += [(i, f"a{1400 + k}zzz b{1400 + k + k % 2}zzz") for k, i in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for top, part in ((pitman_yor.TOP, pitman_yor.PART_TOKENS), (40, 1000)):
        monkeypatch.setattr(pitman_yor, "TOP", top)
        monkeypatch.setattr(pitman_yor, "PART_TOKENS", part)
        found = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
        right, wrong = ([found[i] for k, i in enumerate(held) if k % 2 == odd] for odd in (0, 1))
        assert min(right) > max(wrong) + 0.5


def test_lm_memory_of_a_run(monkeypatch):
    """What asking for the cells of a run of texts holds at once, and that each cell is there with its times."""

    class Taken:
        mapInArrow = lambda self, f, _: f  # noqa: E731, N815

    monkeypatch.setattr(pitman_yor, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    names = np.array([f"w{k}" for k in range(50_000)])
    texts = [" ".join(names[np.minimum(rng.zipf(1.3, 400), 50_000) - 1]) for _ in range(2500)]
    hashes = np.sort(words(*buffers(pa.array(names.tolist())), lower=True)[0])
    top = SimpleNamespace(value=pitman_yor.Words(hashes, np.ones(50_000, np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts), pa.array([False] * 2500)], ["doc_id", "text", "held_out"])
    tracemalloc.start()
    try:
        found = list(pitman_yor._asked(Taken(), top, 40, 1.0)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    blobs = [b.as_py() for out in found for b, kind in zip(out.column("blob"), out.column("kind").to_pylist()) if kind == 1]
    cells = Counter((*p, d) for d, t in enumerate(texts) for w in [t.split()] for p in zip(["\0end", *w], [*w, "\0end"]))
    times = np.concatenate([pitman_yor._unpacked_cells(b)[3] for b in blobs])
    assert sorted(times.tolist()) == sorted(cells.values())
    assert peak < 80 * 401 * len(texts)  # bytes a token


def test_scores_do_not_depend_on_the_layout(odd):
    one, other = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in pitman_yor.score(df).collect()) for df in (odd, odd.repartition(7, "n_chars")))
    assert one == other


def test_scores_do_not_depend_on_how_many_words_are_frequent(odd, monkeypatch):
    """The same rules hold for all words, so neither their number nor the number of parts changes a score."""
    found = []
    for top, part in ((pitman_yor.TOP, pitman_yor.PART_TOKENS), (40, 3000), (0, 20_000)):
        monkeypatch.setattr(pitman_yor, "TOP", top)
        monkeypatch.setattr(pitman_yor, "PART_TOKENS", part)
        found.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in pitman_yor.score(odd).collect()))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert all(a[2] == pytest.approx(b[2], abs=1e-8 * a[1]) for a, b in zip(found[0], other))


def test_stirling_numbers():
    """Against sums over all ways to seat customers."""

    def ways(c, t, d):
        total = 0.0

        def place(sizes, left):
            nonlocal total
            if not left:
                if len(sizes) == t:
                    weight = 1.0
                    for n in sizes:
                        for k in range(1, n):
                            weight *= k - d
                    total += weight
                return
            for k in range(len(sizes)):
                place([n + (i == k) for i, n in enumerate(sizes)], left - 1)
            place([*sizes, 1], left - 1)

        place([1], c - 1)
        return total

    table = pitman_yor.stirling(0.4, 7)
    for c in range(1, 8):
        for t in range(1, c + 1):
            assert math.exp(table[c, t]) == pytest.approx(ways(c, t, 0.4))


def test_drawn_tables_follow_their_distribution():
    d, room, p = 0.4, 9, 0.07
    for c in (2, 3, 6):
        n = 40_000
        got = pitman_yor.draw_tables(np.full(n, c), np.full(n, 2), np.full(n, room), np.full(n, p), d, pitman_yor.stirling(d), np.arange(n, dtype=np.uint64) * np.uint64(7919))
        ways = pitman_yor.stirling(d)
        want = np.array([math.exp(ways[c, t]) * p**t * math.prod(pitman_yor.STRENGTH + d * (room - 2 + j) for j in range(t)) for t in range(1, c + 1)])
        assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, want / want.sum(), atol=0.012)


def test_tables_follow_the_restaurant():
    rng = np.random.default_rng(5)
    c, d, a = 400.0, 0.5, 1.5
    fast = pitman_yor.tables(np.full(3000, c), d, np.full(3000, a), rng).mean()
    slow = []
    for _ in range(300):
        t = 1
        for n in range(1, int(c)):
            t += rng.random() < a / (a + n - d * t)
        slow.append(t)
    assert fast == pytest.approx(np.mean(slow), rel=0.1)


# ---- 9 ------------------------------------------------------------------------------------------------------------------


def test_rules_against_brute_force(odd, labels):
    def want(text):
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        inside = {k for i, x in enumerate(windows) if often[x] > 1 for k in (i, i + 1, i + 2)}
        lines, dup = set(), 0
        for x in (text or "").split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        n = len(w)
        return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n

    rows = quality_rules.judge(odd, labels).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(r.doc_id), *want(r.text)) for r in odd.collect())
    assert not any(r.kept for r in rows if r.base_failed)


def test_rules_learn(spark):
    rng = np.random.default_rng(8)
    plain = [f"word{k}" for k in range(2000)]
    docs, marks = [], []
    for k in range(1200):
        w = rng.choice(plain, 80).tolist()
        bad, toxic = k % 4 == 0, k % 10 == 3
        w = [x + "&&&" for x in w] if bad else w
        for _ in range(3 * toxic):
            w[int(rng.integers(80))] = "horrid"
        docs.append((k, " ".join(w)))
        marks.append((k, int(not bad), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = quality_rules.judge(df, spark.createDataFrame(marks[:800], "doc_id long, quality int, toxic int")).collect()
    late = [(r.kept, marks[r.doc_id]) for r in got if r.doc_id >= 800]
    assert np.mean([kept == (m[1] == 1 and m[2] == 0) for kept, m in late]) > 0.95


# ---- 10 -----------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(10, size=1500)]).astype(np.float32)
    x[700:760] = x[700]  # a group of copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(20000, None), (20020, [0.0] * 16), (20040, [float("nan")] + [1.0] * 15), (20060, [None] + [1.0] * 15), (20080, [1.0]), (20100, [float("inf")] + [1.0] * 15), (20120, []), (None, x[3].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        order = [k for k in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if k != q][:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert all(v == pytest.approx(s[k], abs=1e-9) for _, k, v in mine)
        hit += len({k for _, k, _ in mine} & set(order))
        total += 20
    assert hit / total >= 0.9 and set(got) == set(range(0, 1500, 20))
    few = ann.search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.search(spark.createDataFrame(bad, "vec_id long, embedding array<float>").where("vec_id = 20000"), F.lit(True)).count() == 0


def test_parts_and_blocks_lose_nothing(spark, monkeypatch):
    """Many parts, several blocks a part, a few queries at a time: recall against brute force stays."""
    for name, value in (("PART_ROWS", 50), ("BLOCK", 40), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(2000, 12)) + 3 * rng.normal(size=(25, 12))[rng.integers(25, size=2000)]) * rng.uniform(0.3, 2, (2000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert len(got[q]) == 20
    assert hits / (20 * len(got)) >= 0.93


def test_queries_in_a_small_far_cluster_are_answered(spark):
    """Queries whose own part holds fewer vectors than they ask for go on to others."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(9000, 16)) + 8 * np.eye(16)[0], 0.1 * rng.normal(size=(10, 16)) - 8 * np.eye(16)[0]]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    asked = (F.col("vec_id") % 400 == 0) | (F.col("vec_id") >= 9000)
    got = defaultdict(list)
    for r in ann.search(df, asked).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert set(got) == {*range(0, 9000, 400), *range(9000, 9010)}
    for q, found in got.items():
        assert sorted(n for n, _ in found) == list(range(1, 21)) and len({v for _, v in found} - {q}) == 20
        if q >= 9000:
            assert {v for _, v in found} >= set(range(9000, 9010)) - {q}


@pytest.mark.parametrize("kind", ["tight", "norms", "queries"])
def test_no_neighbour_is_lost_whatever_the_rows_are(spark, monkeypatch, kind):
    """Clusters far tighter than the codes tell, lengths of many sizes, and queries unlike the rest: as by brute force."""
    monkeypatch.setattr(ann, "PART_ROWS", 500)
    monkeypatch.setattr(ann, "CENTRE_SAMPLE", 1000)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    if kind == "tight":
        x = x[:4][rng.integers(4, size=len(x))] + 1e-3 * x
    elif kind == "norms":
        x *= rng.lognormal(0, 1.5, (len(x), 1))
    else:
        x[::200] = 0.1 * x[::200] + 3 * x[0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 200 == 0).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float64)
    for q in range(0, len(x), 200):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s, kind="stable")[:20].tolist())


def test_copies_of_the_own_id_leave_room(spark):
    """Rows that share the query's id are no answers, however many, and don't take the places of others."""
    rng = np.random.default_rng(13)
    rows = [(0, v) for v in (5 + rng.normal(size=(60, 4))).tolist()] + [(0, [1.0] * 4)] * 40 + [(k, [1.0] * 4) for k in range(1, 31)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(k, k) for k in range(1, 21)]


def test_fold(spark):
    got = [r.f for r in spark.createDataFrame([(5,), (None,)], "i long").select(doc_fold(F.col("i"), 3).alias("f")).collect()]
    assert got == [zlib.crc32(b"5") % 3, 0]


def test_pipeline_handles_odd_rows(spark, clashing, empty, tmp_path):
    """Null and repeated ids, clashing columns and no rows at all go through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, docs in (("odd", clashing), ("empty", empty)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == len(pipeline.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() > 5) == (name == "odd")


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in texts() if r[0] is not None and r[0] != 7] + [(7, "seven " + ENGLISH, "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k == 0:
            assert {r.doc_id for r in after} <= {i for i, r in before.items() if any(map(str.isalpha, r.text or ""))}
            assert {r.doc_id for r in after} >= {i for i, r in before.items() if len((r.text or "").split()) > 9}
            assert all(r == before[r.doc_id] for r in after)
        elif k == 1:
            want = plain_lines({i: r.text.split("\n") for i, r in before.items()})
            count = lambda t: len(WORD.findall(t))
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t == before[i].text or count(t) and count(t) >= line_dedup.REMNANT * count(before[i].text)}
        elif k == 2:
            came = {i: t for i, t, *_ in rows if i in before}
            stay = {i for i, c, _ in jaccard_classes(list(came.items())) if i == c}
            classes = jaccard_classes([(i, r.text) for i, r in before.items() if i in stay])
            assert sorted(r.doc_id for r in after) == sorted(i for i, c, _ in classes if i == c)
        elif k == 3:
            words_ = lambda rs: sum(len(WORD.findall(r.text)) for r in rs)
            total, sources = words_(before.values()), {r.source for r in before.values()}
            assert words_(after) == math.floor(1.5 * total) and sources
        else:
            assert sum(r.n_tokens for r in after) == packed_words
        packed_words = sum(len(WORD.findall(r.text)) for r in after) if k < 4 else 0
    assert docs.columns == ["doc_id", "piece", "n_tokens", "bin", "position", "capacity"]
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_components_leave_no_shuffles(spark):
    """Rounds of stars are tidied up behind: only what the last one may still hold is left of their shuffles."""
    tidied, kept_ = [], ngram_join.tidy
    ngram_join.tidy = lambda s: tidied.append(1) or kept_(s)
    try:
        found = ngram_join.components(spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long"))
        assert {(r.node, r.comp) for r in found.collect()} == {(k, 0) for k in range(13)} and len(tidied) >= 2
    finally:
        ngram_join.tidy = kept_
