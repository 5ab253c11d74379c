"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads the whole text, white space and all, from both sides and gives every byte a distribution over the
languages; a document's probabilities are the mean of those of all its letter bytes. The bytes are labelled in windows of
`WINDOW`, each read with `MARGIN` more on either side, by which the states of both directions have warmed up; beyond the
ends of a text stand blanks.

Training takes rows with text and lang outside the held-out fold: at most `MAX_DOCS` documents (least hashes of ids) and
`DOC_WINDOWS` stretches of `SPAN` bytes of each, from anywhere in the text. It stops when the loss on stretches kept apart
no longer falls. lang, source and id are never inputs of a prediction.

Defined results: null text and text without a letter are `und` with score 0; without any training row all text with a
letter is `und`; a language is a non-null value of lang in the sample, ties go to the first by code point; equal rows
get equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, doc_fold, mix, runs, saved, sums

MAX_DOCS, DOC_WINDOWS, SPAN = 3000, 10, 64
WINDOW, MARGIN = 256, 16
HIDDEN = 16
STEPS, BATCH, RATE = 900, 256, 0.015
#: Steps between looks at the loss on stretches kept apart, and how many looks without a fall end the training.
LOOK, PATIENCE, FALL = 50, 3, 0.01
#: Windows that are read side by side.
ABREAST = 1024
UNKNOWN = "und"
_BLANK = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), between -1 and 1: a sigmoid of three cheap steps. Its slope is (1 - |y|)^2 where it gives y."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    """The same between 0 and 1."""
    return np.float32(0.5) * (_bent(x) + np.float32(1))


def _slope(gate: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (1 - np.abs(2 * gate - 1)) ** 2


class Network:
    """One GRU per direction (update, reset, candidate) and a softmax per position over both states."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.classes = h, classes
        self.p = {f"{k}{d}": v.astype(np.float32) for d in (0, 1) for k, v in (("W", rng.normal(0, 0.3, (256, 3 * h))), ("U", rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))), ("b", np.zeros(3 * h)), ("c", np.zeros(h)))}
        self.p |= {"V": rng.normal(0, 0.3, (2 * h, classes)).astype(np.float32), "v": np.zeros(classes, np.float32)}

    def _run(self, x: np.ndarray, d: int, keep: list) -> np.ndarray:
        """States after each position, with what training needs of each step; x: (time, batch), already in the direction's order."""
        h, p = self.h, self.p
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        table, u, c = p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"], p[f"c{d}"]
        for t in range(len(x)):
            a, r_in = table[x[t]], state @ u
            gates = _gate(a[:, : 2 * h] + r_in[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            s = r_in[:, 2 * h :] + c
            n = _bent(a[:, 2 * h :] + r * s)
            keep.append((state, z, r, s, n))
            out[t] = state = n + z * (state - n)
        return out

    def _states(self, x: np.ndarray, d: int) -> np.ndarray:
        """As _run(), for labelling: twice the gates, the halves taken into the weights, no copies."""
        h, p, half = self.h, self.p, np.float32(0.5)
        table = p[f"W{d}"] + p[f"b{d}"]
        wz, wr, wn = (np.ascontiguousarray(table[:, k * h : (k + 1) * h]) for k in range(3))
        uz, ur, un = (np.ascontiguousarray(p[f"U{d}"][:, k * h : (k + 1) * h]) for k in range(3))
        un, c = un * half, p[f"c{d}"] * half
        out = np.empty((*x.shape, h), np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        z, r, n, m, whole = (np.empty_like(state) for _ in range(5))

        def bend(v: np.ndarray) -> None:
            np.abs(v, whole)
            np.add(whole, 1, whole)
            np.divide(v, whole, v)

        for t in range(len(x)):
            np.take(wz, x[t], 0, z, "clip")
            np.take(wr, x[t], 0, r, "clip")
            np.take(wn, x[t], 0, n, "clip")
            np.matmul(state, uz, m)
            z += m
            bend(z)
            np.matmul(state, ur, m)
            r += m
            bend(r)
            r += 1
            np.matmul(state, un, m)
            m += c
            r *= m
            n += r
            bend(n)
            np.subtract(state, n, m)
            m *= half
            z += 1
            m *= z
            state = out[t]
            np.add(n, m, state)
        return out

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        logits = f @ self.p["V"][: self.h] + b @ self.p["V"][self.h :] + self.p["v"]
        logits -= logits.max(-1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(-1, keepdims=True)

    def label(self, x: np.ndarray) -> np.ndarray:
        """Distributions (time, batch, class); x: bytes (time, batch)."""
        return self._softmax(self._states(x, 0), self._states(x[::-1], 1)[::-1])

    def sums(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sums of the distributions at the positions of own, by string (batch, class)."""
        v = self.p["V"]
        e = self._states(x, 0).reshape(-1, self.h) @ v[: self.h]
        e += self._states(x[::-1], 1)[::-1].reshape(-1, self.h) @ v[self.h :]
        e += self.p["v"]
        np.minimum(e, 60, e)  # no state is above 1, so this is beyond any logit of a trained network
        np.exp(e, e)
        share = own.astype(np.float32).ravel() / np.maximum(e @ np.ones(self.classes, np.float32), np.float32(1e-30))
        e *= share[:, None]
        return e.reshape(*x.shape, -1).sum(0)

    def gradients(self, x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the weighted cross entropy over all positions; weight: (time, batch)."""
        h, p = self.h, self.p
        memory: list[list] = [[], []]
        order = (slice(None), slice(None, None, -1))
        states = [self._run(x[order[d]], d, memory[d]) for d in (0, 1)]
        f, b = states[0], states[1][::-1]
        dl = self._softmax(f, b)
        dl[:, np.arange(len(y)), y] -= 1
        dl *= weight[:, :, None]
        both = np.concatenate([f, b], -1).reshape(-1, 2 * h)
        g = {"V": both.T @ dl.reshape(-1, dl.shape[-1]), "v": dl.sum((0, 1))}
        up = dl @ p["V"].T
        for d in (0, 1):
            gu, gc = np.zeros_like(p[f"U{d}"]), np.zeros_like(p[f"c{d}"])
            top, xs = up[:, :, d * h : (d + 1) * h][order[d]], x[order[d]]
            inputs = np.empty((*xs.shape, 3 * h), up.dtype)
            carry = np.zeros((x.shape[1], h), up.dtype)
            for t in range(len(xs) - 1, -1, -1):
                state, z, r, s, n = memory[d][t]
                whole = carry + top[t]
                dn = whole * (1 - z) * (1 - np.abs(n)) ** 2
                dz = whole * (state - n) * _slope(z)
                dr = dn * s * _slope(r)
                inputs[t] = np.concatenate([dz, dr, dn], 1)
                inner = np.concatenate([dz, dr, dn * r], 1)
                gc += inner[:, 2 * h :].sum(0)
                gu += state.T @ inner
                carry = whole * z + inner @ p[f"U{d}"].T
            flat, rows = inputs.reshape(-1, 3 * h), np.argsort(xs.ravel(), kind="stable")
            byte = xs.ravel()[rows]
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            gw = np.zeros_like(p[f"W{d}"])
            gw[byte[first]] = np.add.reduceat(flat[rows], first, axis=0)
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": flat.sum(0), f"c{d}": gc}
        return g


def _loss(net: Network, x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> float:
    p = net.label(x)[:, np.arange(len(y)), y]
    return float(-(np.log(np.maximum(p, 1e-9)) * weight).sum() / max(1, weight.sum()))


def train(stretches: np.ndarray, y: np.ndarray, classes: int, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on batches in which every language has an equal share; stretches: bytes (row, SPAN)."""
    net, rng = Network(classes), np.random.default_rng(seed)
    x, weight = _FOLD[stretches].T, _LETTER[stretches].T.astype(np.float32)
    apart = np.arange(len(y)) % 8 == 7
    test = np.flatnonzero(apart)[:2048]
    by = [np.flatnonzero((y == c) & (~apart | ((y == c).sum() < 8))) for c in range(classes)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    least, since = np.inf, 0
    for step in range(1, steps + 1):
        pick = np.concatenate([own[rng.integers(0, len(own), -(-BATCH // classes))] for own in by])
        own = weight[:, pick]
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradients(x[:, pick], own / max(1, own.sum()), y[pick]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.p[k] -= np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + np.float32(1e-8))
        if step % LOOK == 0 and len(test):
            now = _loss(net, x[:, test], weight[:, test], y[test])
            least, since = (now, 0) if now < (1 - FALL) * least else (least, since + 1)
            if since >= PATIENCE:
                break
    return net


def pooled(net: Network, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of the distributions of its letter bytes, and their number."""
    total, number = np.zeros((len(at) - 1, net.classes)), np.zeros(len(at) - 1, np.int64)
    count = -(-np.diff(at) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    start = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, at[owner + 1] - start)
    order = np.argsort(length, kind="stable")  # windows of like length side by side: short ones take fewer steps
    for k in range(0, len(order), ABREAST):
        part = order[k : k + ABREAST]
        span = int(length[part].max())
        where = start[part] + np.arange(-MARGIN, span + MARGIN)[:, None]
        inside = (where >= at[owner[part]]) & (where < at[owner[part] + 1])
        x = np.where(inside, _FOLD[data[np.clip(where, 0, len(data) - 1)]], np.uint8(_BLANK))
        own = _LETTER[x] & inside
        own[:MARGIN] = own[MARGIN + span :] = False
        own[MARGIN:-MARGIN] &= np.arange(span)[:, None] < length[part]
        np.add.at(total, owner[part], net.sums(x, own))
        np.add.at(number, owner[part], own.sum(0))
    return total, number


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training stretches (row, SPAN), the class of each and the classes in code-point order."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(doc_fold(F.col("doc_id"), 3) != 1)
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("_key"))
    same = ["doc_id", "lang", "_key"]
    some = saved(rows.groupBy(*same).agg(F.lit(1).alias("_one")).drop("_one").orderBy(F.xxhash64(*same), *same).limit(max_docs))
    rows = rows.join(F.broadcast(some), same).dropDuplicates(same).select("lang", "text")  # max_docs rows at most

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            langs, found = [], []
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                seeds = mix(np.arange(DOC_WINDOWS, dtype=np.uint64) + np.uint64(zlib.crc32(data[at[k] : at[k + 1]])) * np.uint64(1 << 16))
                text = np.pad(data[at[k] : at[k + 1]], MARGIN, constant_values=_BLANK)  # as it is read later, blanks at its ends
                for first in np.unique(seeds % np.uint64(max(1, len(text) - SPAN + 1))).tolist():
                    part = text[first : first + SPAN]
                    if _LETTER[part].any():
                        langs.append(lang)
                        found.append(part.tobytes().ljust(SPAN))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "part"])

    got = rows.mapInArrow(pick, "lang string, part binary").toArrow()
    pairs = sorted(zip(got["lang"].to_pylist(), got["part"].to_pylist()), key=lambda p: (zlib.crc32(p[1]), p[0].encode(), p[1]))
    classes = sorted({a for a, _ in pairs}, key=str.encode)
    return np.frombuffer(b"".join(s for _, s in pairs), np.uint8).reshape(-1, SPAN), np.array([classes.index(a) for a, _ in pairs], np.int64), classes


def identify(docs: DataFrame, labelled: DataFrame | None = None, max_docs: int = MAX_DOCS, steps: int = STEPS, accept: float | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from `labelled` (docs, if not given).

    accept: give the documents, with their own columns, that have a language and at least this score.
    """
    stretches, y, classes = sample(docs if labelled is None else labelled, max_docs)
    net = train(stretches, y, len(classes), steps) if len(classes) > 1 else Network(max(1, len(classes)))
    names = classes or [UNKNOWN]
    model = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice = np.array(names, object)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at):
                part, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
                total, n = pooled(model.value, part, edge)
                mean = total / np.maximum(1, n)[:, None]
                best = mean.argmax(1)
                # beyond ASCII not every byte is of a letter: such texts are looked at again
                letters = n > 0
                odd = np.flatnonzero(letters & (sums(((part | 32) >= 97).astype(np.int64) * ((part | 32) <= 122), edge) == 0))
                if len(odd):
                    texts = batch.column("text").slice(i, j - i)
                    letters[odd] = [any(map(str.isalpha, texts[int(k)].as_py())) for k in odd]
                pred = np.where(letters, choice[best], UNKNOWN)
                own = batch.slice(i, j - i)
                score = np.where(letters & (pred != UNKNOWN), np.clip(mean[np.arange(j - i), best], 0, 1), 0.0)
                if accept is not None:
                    yield own.filter(pa.array((pred != UNKNOWN) & (score >= accept)))
                else:
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    if accept is not None:
        return docs.mapInArrow(predict, docs.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
