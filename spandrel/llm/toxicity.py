"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word comes in twice: as itself, if it is one of the commoner words of the training sample, and as its character trigrams.
Both are embedded, the two gated recurrent passes read a window of `WINDOW` words from either end, attention pools their states,
and a logit comes out. A document is cut into windows that overlap by half, all of them are scored, and the highest logit,
calibrated on what networks of the other folds say of the training documents, gives the document's score. Training knows labels of documents only: each round it takes the
window of each document that scores highest so far.

The training sample is bounded: `PER_CLASS` labelled documents of either label, of `LONGEST_CHARS` characters at most, the first by a
hash of their doc_id. Rows whose crc32(doc_id as text) mod 3 is 1 are held out and never learned from.

Defined results: a null, empty or wordless text scores 0; a null label or a label of no document is left out; a doc_id with
several labels counts once per label row; a null doc_id is scored, and is not held out; repeated rows are scored alike;
other columns are ignored by `scores` and returned unchanged by `drop_toxic`; an empty table gives an empty result; without
labels of both kinds nothing can be learned and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import renamed

PER_CLASS, LONGEST_CHARS = 1_000, 20_000
WINDOW, STRIDE = 32, 16
WORDS, TRIGRAMS, LEAST_DOCS = 4_096, 8_192, 3
EMBED, HIDDEN = 12, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 120, 64, 0.01
#: Parts of the training documents for the calibration; each is scored by a network that has not seen it.
FOLDS = 2
CUT = 0.7
#: Windows scored at once, and words whose inputs a worker keeps.
AT_ONCE, KEPT = 2_048, 100_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def trigrams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all words in a row, each as one number, and where each word's begin; a word is marked at both ends."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(lengths.sum()) + np.repeat(2 * np.arange(len(words)), lengths)
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    return np.arange(max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE


class Network:
    """Inputs are rows of (words, 6 * HIDDEN): both directions' update, reset and new gates, before the recurrent part."""

    def __init__(self, words: dict[str, int], trigrams: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        self.words, self.trigrams = words, np.sort(trigrams)
        self.p = {
            "word": normal(len(words) + 1, EMBED, by=0.1), "trigram": normal(len(trigrams) + 1, EMBED, by=0.03),
            "in": normal(2 * EMBED, 6 * HIDDEN, by=1 / math.sqrt(2 * EMBED)), "in_bias": np.zeros(6 * HIDDEN, np.float32),
            "back": normal(2, HIDDEN, 3 * HIDDEN, by=1 / math.sqrt(HIDDEN)),
            "attend": normal(2 * HIDDEN, by=0.5), "out": normal(2 * HIDDEN, by=0.5), "out_bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = self.p["trigram"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def features(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, trigram numbers of all words in a row, and where each word's trigrams begin."""
        keys, starts = trigrams_of(vocabulary)
        at = np.searchsorted(self.trigrams, keys)
        found = at < len(self.trigrams)
        found[found] = self.trigrams[at[found]] == keys[found]
        get = self.words.get
        return np.array([get(w, 0) for w in vocabulary], np.int64), np.where(found, at + 1, 0), starts

    def embedded(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words, flat, starts = features
        counts = np.diff(starts, append=len(flat)).astype(np.float32)[:, None]
        x = np.concatenate([self.p["word"][words], np.add.reduceat(self.p["trigram"][flat], starts) / counts], axis=1)
        return x, counts

    def inputs(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.zeros((0, 6 * HIDDEN), np.float32)
        return self.embedded(self.features(vocabulary))[0] @ self.p["in"] + self.p["in_bias"]

    def logits(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Logits of windows whose words are rows of a table of inputs; row 0 stands for no word."""
        n, length, h = len(rows), rows.shape[1], HIDDEN
        ahead, astern = rows.T, rows.T[::-1]
        gates = np.stack([table[ahead, : 3 * h], table[astern, 3 * h :]], axis=1)  # (length, 2, windows, 3 * h)
        real = None if rows.all() else np.stack([ahead > 0, astern > 0], axis=1)[..., None]
        gates[..., : 2 * h] *= 0.5  # a sigmoid is half a hyperbolic tangent of half its argument, and a half
        recurrent = self.p["back"].copy()
        recurrent[..., : 2 * h] *= 0.5
        states = np.empty((length, 2, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        back, new = np.empty((2, n, 3 * h), np.float32), np.empty((2, n, h), np.float32)
        for t in range(length):
            np.matmul(state, recurrent, out=back)
            zr = back[:, :, : 2 * h]
            zr += gates[t, :, :, : 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(back[:, :, h : 2 * h], back[:, :, 2 * h :], out=new)
            new += gates[t, :, :, 2 * h :]
            np.tanh(new, out=new)
            now = states[t]
            np.subtract(state, new, out=now)
            now *= back[:, :, :h]
            now += new
            if real is not None:
                np.copyto(now, state, where=~real[t])
            state = now
        weights = states[:, 0] @ self.p["attend"][:h] + states[::-1, 1] @ self.p["attend"][h:]
        if real is not None:
            weights[rows.T == 0] = -1e9
        weights = np.exp(weights - weights.max(axis=0))
        told = states[:, 0] @ self.p["out"][:h] + states[::-1, 1] @ self.p["out"][h:]
        return (weights * told).sum(axis=0) / weights.sum(axis=0) + self.p["out_bias"][0]

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """Logits of windows x (windows, WINDOW, 6 * HIDDEN), of which mask says what are words, and what gradients need."""
        n, length, h = len(x), x.shape[1], HIDDEN
        gates = np.ascontiguousarray(np.stack([x[:, :, : 3 * h], x[:, ::-1, 3 * h :]]).transpose(2, 0, 1, 3))
        real = np.ascontiguousarray(np.stack([mask, mask[:, ::-1]]).transpose(2, 0, 1))[..., None].astype(np.float32)
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((length, 2, n, h), np.float32)
        steps = []
        for t in range(length):
            back = state @ self.p["back"]
            zr = _sigmoid(gates[t, :, :, : 2 * h] + back[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(gates[t, :, :, 2 * h :] + r * back[:, :, 2 * h :])
            steps.append((state, z, r, new, back[:, :, 2 * h :]))
            state = states[t] = state + real[t] * (1 - z) * (new - state)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # (length, windows, 2 * HIDDEN)
        weights = np.where(mask.T, both @ self.p["attend"], -1e9)
        weights = np.exp(weights - weights.max(axis=0))
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weights, both)
        return pooled @ self.p["out"] + self.p["out_bias"][0], (steps, real, both, weights, pooled)

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the parameters behind the inputs, and gradients of the inputs."""
        logits, (steps, real, both, weights, pooled) = self.forward(x, mask)
        n, length, h = len(x), x.shape[1], HIDDEN
        chance = _sigmoid(logits)
        loss = float(-np.mean(np.log(np.where(labels > 0.5, chance, 1 - chance) + 1e-7)))
        d = ((chance - labels) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        d_pooled = np.outer(d, self.p["out"])
        through = np.einsum("nh,tnh->tn", d_pooled, both)
        d_weights = weights * (through - (weights * through).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_weights, both)
        d_both = weights[..., None] * d_pooled + d_weights[..., None] * self.p["attend"]
        d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)
        d_gates = np.empty((length, 2, n, 3 * h), np.float32)
        g["back"] = np.zeros_like(self.p["back"])
        carried = np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            state, z, r, new, back_new = steps[t]
            d_now = d_states[t] + carried
            moved = real[t] * d_now
            d_new = moved * (1 - z) * (1 - new * new)
            d_z = -moved * (new - state) * z * (1 - z)
            d_r = d_new * back_new * r * (1 - r)
            d_back = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=2)
            g["back"] += state.transpose(0, 2, 1) @ d_back
            carried = d_now - moved * (1 - z) + d_back @ self.p["back"].transpose(0, 2, 1)
        d_x = np.concatenate([d_gates[:, 0], d_gates[::-1, 1]], axis=2).transpose(1, 0, 2)
        return loss, g, d_x


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def train(texts: list[str], labels: list[int], share: float, seed: int = 0) -> Network | None:
    """A network for the labels; share: of label 1 among all labels, for the calibration. None without both labels."""
    said = [words_of(t) for t in texts]
    kept = [i for i, w in enumerate(said) if w]
    said, y = [said[i] for i in kept], np.array([labels[i] for i in kept], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, told = _fitted(said, y, seed)
    fold = _folds(said, y)
    if all(0 < y[fold != k].sum() < (fold != k).sum() for k in range(FOLDS)):
        for k in range(FOLDS):
            other, _ = _fitted([w for w, f in zip(said, fold) if f != k], y[fold != k], seed)
            at = np.flatnonzero(fold == k)
            told[at] = Scorer(other).highest((said[i] for i in at), len(at))
    _calibrate(net, told, y, share)
    return net


def _folds(said: list[list[str]], y: np.ndarray) -> np.ndarray:
    """Folds of the documents, dealt in turn within each label; equal texts share one."""
    fold: dict[tuple[str, ...], int] = {}
    dealt = Counter()
    for words, label in zip(said, y):
        if (text := tuple(words)) not in fold:
            fold[text] = dealt[label] % FOLDS
            dealt[label] += 1
    return np.array([fold[tuple(words)] for words in said])


def _fitted(said: list[list[str]], y: np.ndarray, seed: int) -> tuple[Network, np.ndarray]:
    """A network that is not calibrated, and its highest logit for each of its documents."""
    by_doc = Counter(x for w in said for x in set(w))
    common = sorted((x for x in by_doc.items() if x[1] >= LEAST_DOCS), key=lambda x: (-x[1], x[0]))[:WORDS]
    vocabulary = sorted(by_doc)
    trigrams, counts = np.unique(trigrams_of(vocabulary)[0], return_counts=True)
    net = Network({w: i + 1 for i, (w, _) in enumerate(common)}, trigrams[np.argsort(-counts, kind="stable")[:TRIGRAMS]], seed)
    number = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: no word
    features = net.features(vocabulary)
    ids = [np.concatenate([np.array([number[x] for x in w], np.int64), np.zeros(WINDOW, np.int64)]) for w in said]
    rows = np.concatenate([d[s : s + WINDOW][None] for d, w in zip(ids, said) for s in windows_of(len(w))])
    doc = np.repeat(np.arange(len(said)), [len(windows_of(len(w))) for w in said])
    begins = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    own = [np.array(sorted({number[x] - 1 for x in w})) for w in said]
    net.p["word"][:, 0] = _odds([np.unique(features[0][o]) for o in own], y, len(net.p["word"]))
    net.p["trigram"][:, 0] = _odds([np.unique(_rows_of(features[1], features[2], o)[0]) for o in own], y, len(net.p["trigram"]))
    r, adam = np.random.default_rng(seed), _Adam(net.p)

    def all_logits() -> np.ndarray:
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), net.embedded(features)[0] @ net.p["in"] + net.p["in_bias"]])
        return np.concatenate([net.logits(table, rows[a : a + AT_ONCE]) for a in range(0, len(rows), AT_ONCE)])

    def highest(logits: np.ndarray) -> np.ndarray:
        order = np.lexsort((-logits, doc))
        return order[begins]

    one, none = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    ends = np.append(begins[1:], len(rows))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (3 * max(len(one), len(none)))))
    for epoch in range(epochs):
        anywhere = r.integers(begins, ends)
        best = anywhere if epoch == 0 else highest(all_logits())
        positive = r.choice(one, len(none)) if len(one) < len(none) else one
        negative = r.choice(none, len(one)) if len(none) < len(one) else none
        picked = np.concatenate([best[positive], best[negative], anywhere[negative]])
        r.shuffle(picked)
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for a in range(0, len(picked), BATCH):
            window = rows[picked[a : a + BATCH]]
            used, at = np.unique(window, return_inverse=True)
            at = at.reshape(window.shape)
            real = used[used > 0] - 1
            named = (features[0][real], *_rows_of(features[1], features[2], real))
            x, counts = net.embedded(named)
            pad = len(used) - len(real)
            table = np.concatenate([np.zeros((pad, 6 * HIDDEN), np.float32), x @ net.p["in"] + net.p["in_bias"]])
            _, g, d_x = net.gradients(table[at], window > 0, y[doc[picked[a : a + BATCH]]])
            d_table = np.zeros_like(table)
            np.add.at(d_table, at.ravel(), d_x.reshape(-1, 6 * HIDDEN))
            d_table = d_table[pad:]
            g["in"], g["in_bias"] = x.T @ d_table, d_table.sum(axis=0)
            d_embedded = d_table @ net.p["in"].T
            for name, to, d in (("word", named[0], d_embedded[:, :EMBED]), ("trigram", named[1], np.repeat(d_embedded[:, EMBED:] / counts, counts[:, 0].astype(int), axis=0))):
                g[name] = np.zeros_like(net.p[name])
                np.add.at(g[name], to, d)
                g[name][0] = 0
            adam.step(net.p, g, rate)
    top = all_logits()
    return net, top[highest(top)]


def _odds(named: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """How surely each number names documents of label 1, from -1 to 1: a start for one dimension of its embedding."""
    counts = np.full((2, size), 0.5)
    for label, numbers in zip(y.astype(int), named):
        counts[label, numbers] += 1
    z = (np.log(counts[1] / (y.sum() + 1)) - np.log(counts[0] / ((1 - y).sum() + 1))) / np.sqrt((1 / counts).sum(axis=0))
    z[0] = 0
    return (z / max(np.abs(z).max(), 1e-6)).astype(np.float32)


def _rows_of(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers and their starts, of some rows only."""
    lengths = np.diff(starts, append=len(flat))[rows]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return flat[np.repeat(starts[rows] - begin, lengths) + np.arange(lengths.sum())], begin


def _calibrate(net: Network, logits: np.ndarray, y: np.ndarray, share: float) -> None:
    """Scale and shift for the highest logits, by a few Newton steps of a weighted, lightly held-back logistic fit."""
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * logits + b)
        w = weight * p * (1 - p) + 1e-6
        grad = np.array([(weight * (p - y) * logits).sum() + (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        hess = np.array([[(w * logits * logits).sum() + 1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    net.scale, net.shift = max(a, 0.05), b


class Scorer:
    """Scores texts one by one in batches of windows; keeps the inputs of words that it has seen."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count(1).__next__)
        self.table, self.known = np.zeros((1_024, 6 * HIDDEN), np.float32), 0

    def _ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        if fresh := list(islice(self.number, self.known, None)):
            if len(self.number) >= len(self.table):
                more = max(len(self.number) + 1 - len(self.table), len(self.table) // 2)
                self.table = np.concatenate([self.table, np.zeros((more, 6 * HIDDEN), np.float32)])
            self.table[self.known + 1 : len(self.number) + 1] = self.net.inputs(fresh)
            self.known = len(self.number)
        return np.concatenate([self.net.logits(self.table, rows[a : a + AT_ONCE]) for a in range(0, len(rows), AT_ONCE)])

    def highest(self, said: Iterable[list[str]], n: int) -> np.ndarray:
        """The highest logit of n texts, given as their words; minus infinity for a text without words."""
        out = np.full(n, -np.inf)
        waiting, owners, held = [], [], 0

        def run() -> None:
            nonlocal waiting, owners, held
            if held:
                np.maximum.at(out, np.repeat([o for o, _ in owners], [k for _, k in owners]), self._logits(np.concatenate(waiting)))
            waiting, owners, held = [], [], 0
            if len(self.number) > KEPT:
                self._forget()

        for i, words in enumerate(said):
            if not words:
                continue
            ids = np.concatenate([self._ids(words), np.zeros(WINDOW, np.int32)])
            starts = windows_of(len(words))
            for a in range(0, len(starts), AT_ONCE):
                some = starts[a : a + AT_ONCE]
                waiting.append(ids[some[:, None] + np.arange(WINDOW)])
                owners.append((i, len(some)))
                held += len(some)
                if held >= AT_ONCE:
                    run()
                    if a + AT_ONCE < len(starts) and not self.number:  # numbers were forgotten within this text
                        ids = np.concatenate([self._ids(words), np.zeros(WINDOW, np.int32)])
        run()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = self.highest(map(words_of, texts), len(texts))
        told = np.isfinite(logits)
        out = np.zeros(len(texts))
        out[told] = _sigmoid(self.net.scale * logits[told] + self.net.shift)
        return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], float]:
    """Texts and labels of the bounded sample, and the share of label 1 among all labels that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text").between(1, LONGEST_CHARS))
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.filter(F.col("toxic") == k).orderBy(*order).limit(2 * PER_CLASS) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    found = texts.join(F.broadcast(ids), "doc_id")  # 4 * PER_CLASS rows at most
    rows = [r for k in (0, 1) for r in found.filter(F.col("toxic") == k).orderBy(*order, "text").limit(PER_CLASS).collect()]
    return [r["text"] for r in rows], [r["toxic"] for r in rows], counted.get(1, 0) / max(1, sum(counted.values()))


def learned(docs: DataFrame, labels: DataFrame) -> Network | None:
    return train(*training_sample(docs, labels))


def with_score(docs: DataFrame, net: Network | None, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by WORDS and TRIGRAMS

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value is not None else None  # of this task alone: a worker lives on
        for b in batches:
            yield pd.Series(scorer.scores(b.tolist()) if scorer else np.zeros(len(b)))

    return docs.withColumn(name, score(F.col("text").cast("string")))


def scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(own, learned(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below the cut, with the columns of docs, whatever their names."""
    named, back = renamed(docs)
    return back(with_score(named, learned(docs, labels), "__score").filter(F.col("__score") < cut))
