"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 in windows of ``WINDOW`` bytes; a forward and a backward
gated unit pass over each window, every position gets a probability for each
language, and a document's probabilities are the mean over all its positions.

A unit has one update gate: ``h += f * (c - h)`` with ``f = sigmoid(...)`` and
``c = tanh(...)`` of the byte and the last state.  Weights are learned on the
driver, in numpy, by backpropagation through time, from a bounded sample:
``SAMPLE_DOCS`` documents a language, of at most ``MOST_LANGS`` languages, and
``SAMPLE_CHARS`` characters of each.  A class of its own, which is never a result,
learns what is no language: windows of the same sample with their bytes shuffled, or
each byte value replaced by another.  As many other documents of each language set
the probability from which on a text counts as recognised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, rows

WINDOW = 64
HIDDEN = 8
#: Windows that are scored at once.
BATCH = 1024
#: The bound of the training sample.
SAMPLE_DOCS = 160
SAMPLE_CHARS = 1024
MOST_LANGS = 512
#: What the bound of acceptance lies under the least probability among the documents that set it.
MARGIN = 0.05
#: Documents that the second sample needs.
LEAST_JUDGED = 20
STEPS = 500
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_positions long"


@dataclass
class Network:
    """Weights: for each direction a byte table and a recurrent matrix, then the output layer.

    The first half of the last axis feeds the gate, stored at half its size so
    that one tanh serves both halves: ``sigmoid(2 x) = (1 + tanh(x)) / 2``.
    """

    langs: list[str]
    table: np.ndarray  # 2 x 256 x 2 HIDDEN
    recur: np.ndarray  # 2 x HIDDEN x 2 HIDDEN
    out: np.ndarray  # 2 HIDDEN x langs, and one more for what is no language
    bias: np.ndarray  # as many
    #: Probability of its language from which on a text is recognised.
    least: float = 0.0

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions at every position of ``windows`` (bytes, time x batch): time x batch x 2 HIDDEN."""
        time, batch = windows.shape
        out = np.empty((time, batch, 2 * HIDDEN), np.float32)
        for side in (0, 1):
            table, recur = self.table[side], self.recur[side]
            h = np.zeros((batch, HIDDEN), np.float32)
            a = np.empty((batch, 2 * HIDDEN), np.float32)
            part = slice(side * HIDDEN, (side + 1) * HIDDEN)
            for t in range(time) if side == 0 else range(time - 1, -1, -1):
                np.take(table, windows[t], axis=0, out=a)
                a += h @ recur
                np.tanh(a, out=a)
                f = a[:, :HIDDEN] * np.float32(0.5)
                f += np.float32(0.5)
                c = a[:, HIDDEN:]
                if keep is not None:
                    keep.append((side, t, h, f, c.copy()))
                h = h + f * (c - h)
                out[t, :, part] = h
        return out

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, and of none, at every position: time x batch x classes."""
        return softmax(self.states(windows) @ self.out + self.bias)

    def label_positions(self, text: str) -> list[str]:
        """The language of each byte of ``text``."""
        data, _, sizes = windowed([text])
        p = self.positions(np.ascontiguousarray(data.T)).transpose(1, 0, 2).reshape(-1, len(self.bias))[: int(sizes[0]), : len(self.langs)]
        return [self.langs[i] for i in p.argmax(axis=1).tolist()]


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windowed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (the last of each filled with zero bytes), the text of each window, and the texts' bytes."""
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    counts = -(-sizes // WINDOW)
    filled = b"".join(d.ljust(int(n) * WINDOW, b"\0") for d, n in zip(data, counts, strict=True))
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts), sizes


def pooled(network: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities of the languages for each text, over all its positions; texts aren't empty."""
    windows, owner, sizes = windowed(texts)
    total = np.zeros((len(texts), len(network.bias)))
    last = np.cumsum(-(-sizes // WINDOW)) - 1
    filled = np.full(len(windows), WINDOW)
    filled[last] = sizes - (-(-sizes // WINDOW) - 1) * WINDOW
    for i in range(0, len(windows), BATCH):
        part = slice(i, i + BATCH)
        p = network.positions(np.ascontiguousarray(windows[part].T))
        n = filled[part]
        for j in np.flatnonzero(n < WINDOW).tolist():
            p[n[j] :, j] = 0
        sums = p.sum(axis=0, dtype=np.float64)
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(owner[part], sums[:, k], len(texts))
    return total[:, : len(network.langs)] / sizes[:, None]


def train(langs: list[str], windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Learns from windows (batch x time bytes) whose every position has the window's label; Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    classes = int(labels.max()) + 1
    net = Network(langs, draw(2, 256, 2 * HIDDEN, scale=0.3), draw(2, HIDDEN, 2 * HIDDEN, scale=0.2), draw(2 * HIDDEN, classes, scale=0.3), np.zeros(classes, np.float32))
    weights = [net.table, net.recur, net.out, net.bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = rng.permutation(len(windows))
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(windows))])
        now, order = order[:batch], order[batch:]
        x = np.ascontiguousarray(windows[now].T)
        grads = gradients(net, x, labels[now])
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            np.clip(g, -1, 1, out=g)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def gradients(net: Network, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all positions of ``x`` (time x batch), through time."""
    tape: list = []
    states = net.states(x, tape)
    time, batch = x.shape
    d = softmax(states @ net.out + net.bias)
    d[:, np.arange(batch), labels] -= 1
    d /= time * batch
    g_out = states.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2])
    g_bias = d.sum(axis=(0, 1))
    d_states = d @ net.out.T
    g_table, g_recur = np.zeros_like(net.table), np.zeros_like(net.recur)
    carry = None
    for n in range(len(tape) - 1, -1, -1):
        side, t, h, f, c = tape[n]
        if carry is None or (n + 1 < len(tape) and tape[n + 1][0] != side):
            carry = np.zeros((batch, HIDDEN), np.float32)
        dh = carry + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
        # the gate is (1 + tanh) / 2, so its slope is (1 - tanh^2) / 2 = 2 f (1 - f)
        da = np.concatenate([dh * (c - h) * 2 * f * (1 - f), dh * f * (1 - c * c)], axis=1)
        np.add.at(g_table[side], x[t], da)
        g_recur[side] += h.T @ da
        carry = dh * (1 - f) + da @ net.recur[side].T
    return [g_table, g_recur, g_out, g_bias]


def no_language(windows: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """``n`` windows that are no language, made of ``windows``: half have their bytes shuffled, half have each byte value replaced by another, not the space, of the whole range or of one stretch of it."""
    rng = np.random.default_rng(seed)
    out = windows[rng.integers(0, len(windows), n)].copy()
    half = n // 2
    out[:half] = rng.permuted(out[:half], axis=1)
    for i in range(half, n):
        low, size = (0, 256) if i % 2 else (int(rng.integers(1, 225)), 32)
        table = (low + rng.permutation(256) % size).astype(np.uint8)
        table[[0, 32]] = [0, 32]
        out[i] = table[out[i]]
    return out


def held_out(doc_id: Column | str, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning; false where it has no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(df: DataFrame) -> Network | None:
    """A network for the non-null ``lang`` values of the documents (``doc_id``, ``text``, ``lang``) that aren't held out.

    None where there is nothing to learn from: an empty table, or no row with an
    id, a language and a text that isn't empty.  Repeated rows count as often as
    they occur, other columns are ignored.  More than ``MOST_LANGS`` languages are
    an error.  ``least`` of the network is ``MARGIN`` under the least probability
    of its best language that a document of a second sample has, none of which is
    in the first; where that has under ``LEAST_JUDGED`` documents it is 0, as what
    was learned by heart tells nothing of other texts.
    """
    known = df.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    found = {r["lang"]: r["n"] for r in counts}
    if not found:
        return None
    langs = sorted(found)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, 3.0 * SAMPLE_DOCS / n))) for name, n in sorted(found.items())])
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)) + 1
    chosen = known.select("lang", draw.alias("draw"), "doc_id", F.substr("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("part")).where(F.col("draw") < share).collect()
    windows, labels, judged = [], [], []
    for k, name in enumerate(langs):
        own = [p for _, _, p in sorted((r["draw"], r["doc_id"], r["part"]) for r in chosen if r["lang"] == name)]
        data = own[:SAMPLE_DOCS]
        judged += own[SAMPLE_DOCS : 2 * SAMPLE_DOCS]
        if data:
            w, _, sizes = windowed(data)
            full = np.ones(len(w), bool)
            full[np.cumsum(-(-sizes // WINDOW))[(sizes % WINDOW > 0) & (sizes > WINDOW)] - 1] = False
            windows.append(w[full])
            labels.append(np.full(int(full.sum()), k))
    if not windows:
        return None
    x, y = np.concatenate(windows), np.concatenate(labels)
    other = no_language(x, -(-len(x) // len(langs)))
    network = train(langs, np.concatenate([x, other]), np.concatenate([y, np.full(len(other), len(langs))]))
    judged = [t for t in judged if has_letter(t)]
    network.least = max(0.0, float(pooled(network, judged).max(axis=1).min()) - MARGIN) if len(judged) >= LEAST_JUDGED else 0.0
    return network


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any alphabet."""
    return bool(text) and any(map(str.isalpha, text))


def identify(df: DataFrame, network: Network | None) -> DataFrame:
    """The language of the whole ``text`` of every row, from the text alone.

    ``score`` is the pooled probability of the language, from 0 to 1.  A text
    that is null or has no letter gets ``und`` and 0, as all do without a
    network.  Repeated rows are judged alike; other columns are ignored; a null
    ``doc_id`` is carried and counts as not held out.
    """
    sent = df.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            at = [i for i, t in enumerate(texts) if net and has_letter(t)]
            langs, scores, sizes = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            if at:
                p = pooled(net, [texts[i] for i in at])
                best = p.argmax(axis=1)
                for i, b, s in zip(at, best.tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i], sizes[i] = net.langs[b], min(1.0, s), len(texts[i].encode())
            yield rows(PREDICTED, doc_id=batch["doc_id"], held_out=batch["held_out"], lang_pred=langs, score=scores, n_positions=sizes)

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out")), work, PREDICTED)


def accepted(df: DataFrame, network: Network | None, least: float | None = None) -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language with a pooled probability of at least ``least`` (unset: the network's own bound).

    Texts that are null, empty or without a letter go.  Without a network every
    text that has a letter stays, as nothing tells them apart.  Repeated rows stay
    or go alike, rows without ``doc_id`` are judged like others, and an empty table
    stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            at = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64)
            if len(at) and net:
                at = at[pooled(net, [texts[i] for i in at.tolist()]).max(axis=1) >= (net.least if least is None else least)]
            yield batch.take(pa.array(at))

    return map_batches(df, work, df.schema)
