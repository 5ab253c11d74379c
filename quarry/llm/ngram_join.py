"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is the set of its five-word shingles (words are runs of anything but white space, in ASCII lower case; a text
of one to four words is one shingle of all of them). Equal sets are one node, found by a digest, so copies meet as one row
per node. Each node has a label of `DEPTH` MinHash values in each of `TREES` prefix tries. The labels of all tries are
range-sorted; neighbours in that order and the length of the prefix they share are all that is kept of the tries.

Candidates are nodes that share a prefix in some trie: the full label at first, then shorter and shorter ones. A node stops
shortening when the links found for it say that hardly any is missing: each link of similarity s is found by a prefix of
d values with probability 1 - (1 - s^d)^TREES, so it stands for the inverse of that many, and the node is done when the
links found reach the target recall of that sum. Pairs of two nodes that are done aren't compared any more. Nodes without
a link go on to the prefix with which a pair of just the threshold's similarity meets with the target recall.

Neighbours chain to components; those up to `ITEM_SHINGLES` are matched and verified in one piece, from the full prefix to
the last one; larger ones in rounds, prefix by prefix (or as one, if that is less work), split into pairs of blocks of that
size, so no task holds an unbounded group and pairs are never rows. Verification counts the common shingles of all candidate pairs.

Shingles are compared by 64-bit hashes and sets by 128-bit digests.

Defined results: null text, text without a word and rows without id are linked to nothing and are their own class (a row
without id has a null class); rows that share an id are compared by their texts; equal rows are linked copies; an empty
table gives no rows; other columns are ignored by near_duplicates() and kept, whatever their names, by one_of_each().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, kept, mix, runs, saved, tidy, words

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 10, 0.999
#: Values by which a prefix is shortened at a time.
SHORTER = 2
ITEM_SHINGLES, BLOCK_NODES = 1 << 22, 1 << 11
#: Candidate texts are read again by id: by broadcast up to so many, by a shuffle beyond.
BROADCAST_IDS = 1 << 21


def met(similarity, prefix: int, trees: int = TREES):
    """Probability that a pair shares a prefix of so many values in some trie."""
    return 1 - (1 - similarity**prefix) ** trees


def prefixes(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """Lengths from the full label down to that with which a pair of just that similarity meets with the target recall."""
    least = next((d for d in range(depth, 1, -1) if met(similarity, d, trees) >= recall), 1)
    return sorted({*range(depth, least, -SHORTER), least}, reverse=True)


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Per text its ascending distinct shingle hashes."""
    h, _, _, first = words(data, at, lower=True)
    n = len(h) - SHINGLE + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE):
        rolled += mix(h[k : k + max(0, n)] + np.uint64(k + 1)) * np.uint64(2 * k * k + 9)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in range(a, b):
                short = mix(short * np.uint64(31) + h[x : x + 1])
            out.append(short)
        else:
            out.append(h[:0])
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _signature(own: np.ndarray, seeds: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Minima of the hashes, one per seed; long sets in pieces."""
    low = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
    for i in range(0, len(x), 2048):
        y = (x[None, i : i + 2048] ^ seeds[:, None]) * odds[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(low, y.min(1), out=low)
    return low


def signatures(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, key (of the text), node, n, labels (DEPTH values of 16 bits for each tree); node is null without a shingle."""
    seeds = np.random.default_rng(42).integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32)
    odds = np.random.default_rng(43).integers(0, 1 << 31, trees * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, bytes] = {}
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at):
                nodes, sizes, labels = [], [], []
                for own in shingles(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                    node = digest(own) if len(own) else None
                    nodes.append(node)
                    sizes.append(len(own))
                    if node is not None and node not in memory:
                        if len(memory) > 20_000:
                            memory.clear()
                        memory[node] = (_signature(own, seeds, odds) >> np.uint32(16)).astype(">u2").tobytes()
                    labels.append(memory.get(node))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "key")), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "key", "node", "n", "labels"])

    return docs.mapInArrow(sign, "doc_id long, key binary, node binary, n long, labels binary")


def neighbours(nodes: DataFrame, least: int, trees: int = TREES) -> DataFrame:
    """a, b, shared: neighbours in the sorted order of a trie's labels that share a prefix of `least` values or more.

    nodes: node, labels. Tasks see their part of the order in a stream; what stands at the edges of the parts is compared
    afterwards, two rows a part.
    """
    width = 2 * DEPTH
    leaves = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels")
    leaves = leaves.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), F.substring("labels", F.col("tree") * width + 1, F.lit(width))).alias("label"), "node")
    leaves = leaves.repartitionByRange("label", "node").sortWithinPartitions("label", "node")

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values that labels share from the front; -1: of different trees."""
        same = (x == y).reshape(len(x), -1, 2).all(2)
        return np.logical_and.accumulate(same, 1).sum(1) - 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = ["a", "b", "shared", "part", "label"], TaskContext.get().partitionId()
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, width + 2)
            node = batch.column("node").to_pylist()
            if last is None:
                first = node[0], label[0].tobytes()
            else:
                label, node = np.concatenate([np.frombuffer(last[1], np.uint8)[None], label]), [last[0], *node]
            shared = common(label[1:], label[:-1])
            hit = np.flatnonzero(shared >= least)
            null = pa.nulls(len(hit), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([node[k + 1] for k in hit], pa.binary()), pa.array([node[k] for k in hit], pa.binary()), pa.array(shared[hit].astype(np.int32)), null, pa.nulls(len(hit), pa.binary())], names)
            last = node[-1], label[-1].tobytes()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first[0], last[0]], pa.binary()), pa.nulls(2, pa.binary()), pa.array([0, 1], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([first[1], last[1]], pa.binary())], names)

    found = kept(leaves.mapInArrow(compare, "a binary, b binary, shared int, part int, label binary"))
    edges = [(bytes(r.a), bytes(r.label)) for r in found.where("part is not null").orderBy("part", "shared").collect()]  # two a task
    more = []
    for (a, x), (b, y) in zip(edges[2::2], edges[1::2]):
        n = int(common(np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None])[0])
        if n >= least:
            more.append((bytearray(a), bytearray(b), n))
    links = found.where("part is null").select("a", "b", "shared")
    return links.unionByName(nodes.sparkSession.createDataFrame(more, "a binary, b binary, shared int")) if more else links


def components(edges: DataFrame) -> DataFrame:
    """node, comp of an edge list (a, b): the least node of its connected component, by alternating large and small stars.

    Least neighbours are made a table before they are joined, so that the rows of a hot centre can be split among tasks.
    """
    ends = edges.where("a <> b")
    edges = saved(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        del both, least, large, small
        tidy(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair have in common."""
    if not len(left):
        return np.zeros(0, np.int64)
    used, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = inverse[: len(left)], inverse[len(left) :]
    own = [sets[i] for i in used]
    size = np.array([len(s) for s in own])
    flat = np.concatenate(own)
    doc = np.repeat(np.arange(len(own)), size)
    _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[term] > 1
    rank = np.cumsum(df > 1) - 1
    term, doc = rank[term[shared]], doc[shared]
    terms = int((df > 1).sum())
    dense = 2.0 * len(own) ** 2 * terms / 8e9
    pairwise = len(left) * 15e-6 + (size[left] + size[right]).sum() * 2e-8
    if dense <= pairwise:
        out = np.zeros(len(left), np.float32)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        step = max(1, (1 << 22) // len(own))
        total = np.zeros((len(own), len(own)), np.float32)
        for a in range(0, terms, step):
            lo, hi = np.searchsorted(term, [a, a + step])
            m = np.zeros((len(own), min(step, terms - a)), np.float32)
            m[doc[lo:hi], term[lo:hi] - a] = 1
            total += m @ m.T
        out = total[left, right]
        return out.astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(own)))])
    parts = [np.sort(term[bounds[i] : bounds[i + 1]]) for i in range(len(own))]
    found = np.empty(len(left), np.int64)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = (parts[a], parts[b]) if len(parts[a]) < len(parts[b]) else (parts[b], parts[a])
        at = np.searchsorted(y, x)
        found[k] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x) if len(y) else 0
    return found


def codes(labels: np.ndarray, prefix: int) -> np.ndarray:
    """A 64-bit number for the first values of each label (row, tree, value)."""
    out = np.zeros(labels.shape[:2], np.uint64)
    for k in range(prefix):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, k])
    return out


def verify(sets: list[np.ndarray], now: np.ndarray, before: np.ndarray | None, copies: np.ndarray, live: np.ndarray, side: np.ndarray, tree: int, similarity: float, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: documents linked to it, the node that leads its group, its links, and for each prefix length how many
    links are likely missing beside them.

    Compared are pairs that share a code of `now` but none of `before`, one of them live. tree: -1, or the one whose pairs
    count here, if they share no earlier code; side: bit 1 and bit 2, pairs are between the two."""
    m = len(sets)
    links, pairs, missing, lead = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, len(lengths))), np.arange(m)
    size = np.array([len(s) for s in sets], np.int64)

    def root(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    step = max(1, (1 << 21) // max(1, m))
    for a in range(0, m, step):
        rows = np.arange(a, min(a + step, m))
        low, high = np.minimum(size[rows][:, None], size[None, :]), np.maximum(size[rows][:, None], size[None, :])
        eq = (np.arange(m)[None, :] > rows[:, None]) & (low >= similarity * high - 1e-9) & (live[rows][:, None] | live[None, :])
        eq &= ((side[rows][:, None] & 1) & (side[None, :] >> 1)).astype(bool) | ((side[rows][:, None] >> 1) & (side[None, :] & 1)).astype(bool)
        if tree >= 0:
            eq &= now[rows, tree][:, None] == now[None, :, tree]
            for t in range(tree):
                eq &= now[rows, t][:, None] != now[None, :, t]
        else:
            some = np.zeros(eq.shape, bool)
            for t in range(now.shape[1]):
                some |= now[rows, t][:, None] == now[None, :, t]
            eq &= some
        for t in range(now.shape[1] if before is not None else 0):
            eq &= before[rows, t][:, None] != before[None, :, t]
        i, j = np.nonzero(eq)
        i = rows[i]
        both = common_counts(sets, i, j)
        good = both >= similarity * (size[i] + size[j] - both) - 1e-9
        i, j, both = i[good], j[good], both[good]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for x in (i, j):
            np.add.at(pairs, x, 1)
            for k, d in enumerate(lengths):
                np.add.at(missing[:, k], x, 1 / met(both / (size[i] + size[j] - both), d, now.shape[1]) - 1)
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = root(x), root(y)
            if x != y:
                lead[max(x, y)] = min(x, y)
    return links, np.array([root(i) for i in range(m)], np.int64), pairs, missing


def settle(sets: list[np.ndarray], labels: np.ndarray, copies: np.ndarray, similarity: float, lengths: list[int], recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node of one component: documents linked to it, the node that leads its group, its links. The full prefix first,
    then shorter ones, each node until its links found reach the recall of those it is likely to have."""
    m = len(sets)
    links, pairs, missing, lead = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, len(lengths))), np.arange(m)
    live, before = np.ones(m, bool), None
    for step, prefix in enumerate(lengths):
        now = codes(labels, prefix)
        more = verify(sets, now, before, copies, live, np.full(m, 3), -1, similarity, lengths)
        links, pairs, missing, before = links + more[0], pairs + more[2], missing + more[3], now
        for k in np.flatnonzero(more[1] != np.arange(m)).tolist():
            a, b = sorted((lead[k], lead[more[1][k]]))
            lead[lead == b] = a
        live = (pairs == 0) | (missing[:, step] > (1 - recall) * pairs)
        if not live.any():
            break
    return links, lead, pairs


def _tasks_done(kernel, columns: list[str]):
    """Rows that come by key, given to the kernel a key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for own_key, *rest in zip(*(part.column(c).to_pylist() for c in ["key", *columns])):
                    if own_key != key and rows:
                        yield kernel(rows)
                        rows = []
                    key = own_key
                    rows.append(rest)
        if rows:
            yield kernel(rows)

    return run


def _labels(rows: list[list], at: int, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), ">u2").reshape(len(rows), trees, DEPTH).astype(np.uint64)


def _whole(lengths: list[int], trees: int, similarity: float, recall: float):
    """The kernel for components that are verified in one piece."""

    def kernel(rows: list[list]) -> pa.RecordBatch:
        names = [r[0] for r in rows]
        links, lead, _ = settle([np.frombuffer(r[3], np.uint64) for r in rows], _labels(rows, 1, trees), np.array([r[2] for r in rows], np.int64), similarity, lengths, recall)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[k] for k in lead], pa.binary()), pa.array(links)], ["node", "lead", "links"])

    return _tasks_done(kernel, ["node", "labels", "copies", "own"])


def _split(lengths: list[int], step: int, trees: int, similarity: float):
    """The kernel for prefixes and blocks of large components."""

    def kernel(rows: list[list]) -> pa.RecordBatch:
        names, labels = [r[0] for r in rows], _labels(rows, 1, trees)
        now, before = codes(labels, lengths[step]), codes(labels, lengths[step - 1]) if step else None
        copies, live, side = (np.array([r[k] for r in rows]) for k in (2, 4, 5))
        links, lead, pairs, missing = verify([np.frombuffer(r[3], np.uint64) for r in rows], now, before, copies, live, side, rows[0][6], similarity, lengths)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[k] for k in lead], pa.binary()), pa.array(links), pa.array(pairs), pa.array(list(missing), pa.list_(pa.float64()))], ["node", "lead", "links", "pairs", "missing"])

    return _tasks_done(kernel, ["node", "labels", "copies", "own", "live", "side", "tree"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own (shingle hashes) of the wanted nodes (doc_id, node), once each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            want = batch.column("node").to_pylist()
            for i, j in runs(at):
                found = [(k, own) for k, own in zip(range(i, j), shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])) if len(own) and digest(own) == want[k]]
                yield pa.RecordBatch.from_arrays([pa.array([want[k] for k, _ in found], pa.binary()), pa.array([own.tobytes() for _, own in found], pa.binary())], ["node", "own"])

    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("node", "text")
    return texts.mapInArrow(sets, "node binary, own binary").dropDuplicates(["node"])


def _blocks(member: DataFrame, prefix: int, longer: int | None, trees: int, item: int) -> DataFrame:
    """node, deal, key, tree, side: where each node (node, n, labels, live, comp) of large components is verified: once per
    shared prefix, or once with its component if that is less work, and per pair of blocks. Prefixes without a live node, or
    whose nodes all share the longer prefix, are left out."""
    at = F.col("tree") * (2 * DEPTH) + 1
    leaf = member.select("node", "n", "live", "comp", "labels").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    leaf = leaf.select("node", "n", "live", "comp", "tree", F.substring("labels", at, F.lit(2 * prefix)).alias("label"), F.substring("labels", at, F.lit(2 * (longer or prefix))).alias("long"))
    groups = leaf.groupBy("comp", "tree", "label").agg(F.count("*").alias("k"), F.sum("n").alias("weight"), F.max("live").alias("any"), (F.min("long") < F.max("long")).alias("new"))
    groups = saved(groups.where("k > 1 and any" + (" and new" if longer else "")))
    sizes = member.groupBy("comp").agg(F.count("*").alias("all"), F.sum("n").alias("sum"))
    dense = groups.groupBy("comp").agg(F.sum(F.col("k") * F.col("k")).alias("work")).join(sizes, "comp")
    dense = saved(dense.select("comp", "all", "sum", (F.col("all") * F.col("all") <= F.col("work")).alias("dense")))
    one = member.join(dense.where("dense"), "comp").select("node", F.col("comp").alias("label"), F.lit(-1).alias("tree"), F.col("all").alias("k"), F.col("sum").alias("weight"))
    each = leaf.join(saved(groups.join(dense.where("not dense").select("comp"), "comp").select("tree", "label", "k", "weight")), ["tree", "label"]).select("node", "label", "tree", "k", "weight")
    large = one.unionByName(each)
    blocks = F.least(F.col("k"), F.greatest(F.ceil(F.col("weight") * 2 / item), F.ceil(F.col("k") / BLOCK_NODES)))
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
    key = F.unhex(F.sha1(F.concat_ws("/", "tree", F.hex("label"), low, high).cast("binary")))
    return large.select("node", F.xxhash64("tree", "label", low, high).alias("deal"), key.alias("key"), "tree", side.alias("side"))


def _large(member: DataFrame, own: DataFrame, lengths: list[int], trees: int, similarity: float, recall: float, item: int) -> DataFrame:
    """node, lead, links of the nodes of large components: round by round from the full prefix to shorter ones."""
    checked, live = None, member.select("node", F.lit(True).alias("live"))
    for step, prefix in enumerate(lengths):
        now = saved(member.join(live, "node"))
        tasks = _blocks(now, prefix, lengths[step - 1] if step else None, trees, item)
        tasks = tasks.join(now.select("node", "labels", "copies", "live"), "node").join(own, "node").repartition("deal").sortWithinPartitions("key", "node")
        found = tasks.select("key", "node", "labels", "copies", "own", "live", "side", "tree").mapInArrow(_split(lengths, step, trees, similarity), "node binary, lead binary, links long, pairs long, missing array<double>")
        found = kept(found.where("pairs > 0"))
        del tasks
        tidy(found.sparkSession)
        checked = found if checked is None else checked.unionByName(found)
        if prefix != lengths[-1]:
            state = checked.groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum(F.get("missing", F.lit(step))).alias("missing"))
            done = state.where(F.col("missing") <= (1 - recall) * F.col("pairs")).select("node", F.lit(False).alias("live"))
            live = member.select("node").join(done, "node", "left").select("node", F.coalesce("live", F.lit(True)).alias("live"))
    groups = components(checked.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    count = checked.groupBy("node").agg(F.sum("links").alias("links"))
    return count.join(groups, "node").select("node", F.col("comp").alias("lead"), "links")


def classes(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, item: int = ITEM_SHINGLES) -> DataFrame:
    """doc_id, key, node, comp, class_id, n_links per document; node and comp are null where nothing can be linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    lengths = prefixes(similarity, trees, DEPTH, recall)
    signed = kept(signatures(docs, trees))
    named = signed.where("node is not null and doc_id is not null")
    nodes = kept(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("labels").alias("labels")))
    comp = saved(components(neighbours(nodes, lengths[-1], trees)))
    member = kept(nodes.join(comp, "node"))
    own = kept(_sets(docs, member.select(F.col("rep").alias("doc_id"), "node")))
    tidy(own.sparkSession)
    sizes = member.groupBy("comp").agg(F.sum("n").alias("weight"), F.count("*").alias("k"))
    sizes = saved(sizes.select("comp", ((F.col("weight") <= item) & (F.col("k") <= 4 * BLOCK_NODES) | (F.col("k") <= 2)).alias("whole")))
    tasks = member.join(sizes.where("whole").select("comp"), "comp").select("node", F.col("comp").alias("key"), "labels", "copies").join(own, "node").repartition("key").sortWithinPartitions("key", "node")
    linked = tasks.select("key", "node", "labels", "copies", "own").mapInArrow(_whole(lengths, trees, similarity, recall), "node binary, lead binary, links long").where("links > 0")
    big = sizes.where("not whole").select("comp")
    if not big.isEmpty():
        linked = linked.unionByName(_large(kept(member.join(big, "comp")), own, lengths, trees, similarity, recall, item))
    linked = kept(linked)
    del tasks
    tidy(linked.sparkSession)
    named = nodes.select("node", "rep", "copies").join(linked, "node", "left")
    named = saved(named.select("node", "rep", F.coalesce("lead", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = saved(named.groupBy("comp").agg(F.min("rep").alias("class_id")))
    named = named.join(least, "comp").select("node", "comp", "class_id", "n_links")
    rows = signed.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    return rows.select("doc_id", "key", "node", "comp", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, item: int = ITEM_SHINGLES) -> DataFrame:
    """doc_id, class_id (the least id of its class), n_links (other documents at least that similar) per document."""
    return classes(docs, similarity, trees, recall, item).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, before: DataFrame | None = None) -> DataFrame:
    """The columns of docs; of each class the row of the least id, then of the least md5 of its text. Rows equal in both are one document.

    before: the same documents as they came (doc_id, text), for texts that lost lines since: what is left of two near copies may
    resemble each other no more. Of each class of those texts the least id that is still in docs stays, too. Ids that stand there
    more than once, and documents that are longer now, are left to their text of now.
    """
    if before is not None:
        docs = _first_as_they_came(docs, before, similarity)
    found = kept(classes(docs, similarity).where("comp is not null").groupBy("comp", "doc_id", "key").agg(F.count("*").alias("rows")))
    first = saved(found.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("first")))
    gone = found.join(first, "comp").where(F.struct("doc_id", "key") != F.col("first")).select(F.col("doc_id").alias("id"), "key")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    rows = rows.join(gone, ["id", "key"], "left_anti")
    if found.where("rows > 1").limit(1).count():
        rows = rows.where("id is not null").dropDuplicates(["id", "key"]).unionByName(rows.where("id is null"))
    return rows.select("row.*")


def _first_as_they_came(docs: DataFrame, before: DataFrame, similarity: float) -> DataFrame:
    """docs without those whose text in `before` resembles that of a lesser id in docs. Only ids and lengths meet; no text moves for it."""
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("now")).where("doc_id is not null and now is not null")
    came = before.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("came")).where("doc_id is not null")
    found = classes(before, similarity).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("comp").alias("comp"))
    found = found.where("rows = 1 and comp is not null").select("doc_id", "comp")
    found = kept(found.join(now, "doc_id").join(came, "doc_id").where("now <= came").select("doc_id", "comp").distinct())
    gone = found.join(found.groupBy("comp").agg(F.min("doc_id").alias("first")), "comp").where("doc_id <> first").select(F.col("doc_id").alias("_gone"))
    gone = kept(gone.distinct())
    del found
    tidy(docs.sparkSession)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
