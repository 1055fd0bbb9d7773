"""Quality classifier: a byte-level convolutional network written in numpy.

Learned filters of WIDTH bytes slide over chunks of CHUNK bytes that overlap by WIDTH - 1, so that every window of the
whole text is seen.  Each filter is max-pooled over a chunk and rectified; a fixed plane adds, per chunk, how much of
it repeats at a short lag.  Mean and maximum over the chunks feed one logistic unit.  Filters and unit are trained
together by Adam; the gradient of a filter reaches only the window that won the maximum.

A score depends on its text alone: padding stands before and after every text, so that neither a window nor a lag
reaches a neighbour.

The fit uses a bounded sample (SAMPLE documents of each class, at most SAMPLE_CHARS characters each); scoring reads
every whole text.  Empty and null texts are one chunk of padding and get a defined score; a very long text is scored
STEP chunks at a time; equal texts have equal scores, and repeated rows and null ids are scored each; an empty table
gives an empty result.  Without labels of both classes every score is the prior.  Given columns of the names it adds are
replaced, others aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fold, labelled_sample, map_texts

FILTERS, WIDTH, CHUNK, PAD = 16, 6, 512, 256
SAMPLE, SAMPLE_CHARS, EPOCHS, UPDATES, BATCH, RATE = 2500, 12_000, 8, 300, 32, 0.01
LAGS, WINDOW = range(2, 26), 64
#: Chunks in one step of a scoring pass (bounds its memory: about 512 x 512 x 16 floats).
STEP = 512


#: Padding around every text: no shorter than a filter or a lag.
GAP = 32


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array with padding around each, the start of every chunk, and the number of chunks of each text."""
    n = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
    first = np.concatenate([[0], np.cumsum(n * CHUNK + GAP)[:-1]]) + GAP
    x = np.full(int((n * CHUNK + GAP).sum()) + GAP, PAD, np.int16)
    for t, at in zip(texts, first):
        x[at : at + len(t)] = np.frombuffer(t, np.uint8)
    chunk = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return x, np.repeat(first, n) + chunk * CHUNK, n


def convolve(x: np.ndarray, starts: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Filter values of every window: (chunks, CHUNK, FILTERS).  A table holds a filter's weight for each byte."""
    rows = x[starts[:, None] + np.arange(CHUNK + WIDTH - 1)]
    y = tables[0].take(rows[:, :CHUNK], axis=0)
    for j in range(1, WIDTH):
        y += tables[j].take(rows[:, j : j + CHUNK], axis=0)
    return y


def repeats(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(chunks, 2): mean and maximum over windows of the best share of bytes that repeat at one lag."""
    most = LAGS[-1]
    rows = x[starts[:, None] + np.arange(-most, CHUNK)]
    here = rows[:, most:]
    inside = here != PAD
    best = np.zeros((len(starts), CHUNK // WINDOW), np.int32)
    for lag in LAGS:
        same = (here == rows[:, most - lag : most - lag + CHUNK]) & inside
        np.maximum(best, same.reshape(len(starts), -1, WINDOW).sum(axis=2, dtype=np.int32), out=best)
    share = best / WINDOW
    return np.stack([share.mean(axis=1), share.max(axis=1)], axis=1)


def combine(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over each document's chunks, and the chunk that holds each maximum."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = np.add.reduceat(h, starts, axis=0) / n[:, None]
    peak = np.maximum.reduceat(h, starts, axis=0)
    where = np.stack([s + h[s : s + k].argmax(axis=0) for s, k in zip(starts, n)]) if len(n) else np.zeros((0, h.shape[1]), int)
    return np.concatenate([mean, peak], axis=1), where


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(sample: list[tuple[str, int]], seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
    tables[:, PAD] = 0
    width = FILTERS + 2
    w, bias = rng.normal(0, 0.1, 2 * width), np.zeros(1)
    texts, y = [t.encode() for t, _ in sample], np.array([float(v) for _, v in sample])
    if len(set(y)) < 2:  # nothing to learn: the prior
        return {"tables": tables, "w": np.zeros(2 * width), "b": np.array([4.0 * (y.mean() - 0.5) if len(y) else 0.0])}
    share = {0.0: (y == 0).mean(), 1.0: (y == 1).mean()}
    params = [tables, w, bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    # A small sample is gone through more often: at least UPDATES steps in all.
    for _ in range(max(EPOCHS, -(-UPDATES // -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            x, starts, n = layout([texts[i] for i in pick])
            conv = convolve(x, starts, tables)
            won = conv.argmax(axis=1)
            top = np.take_along_axis(conv, won[:, None], 1)[:, 0]
            h = np.concatenate([np.maximum(top, 0), repeats(x, starts)], axis=1)
            f, where = combine(h, n)
            weight = np.array([0.5 / share[v] for v in y[pick]])
            g = (sigmoid(f @ w + bias) - y[pick]) * weight / len(pick)
            gw, gb = f.T @ g + 1e-4 * w, np.array([g.sum()])
            gh = np.repeat(g / n, n)[:, None] * w[None, :width]
            np.add.at(gh, (where, np.arange(width)[None, :]), g[:, None] * w[None, width:])
            gh = (gh[:, :FILTERS] * (top > 0)).astype(np.float32)
            gt = np.zeros_like(tables)
            pos = starts[:, None] + won
            for j in range(WIDTH):
                np.add.at(gt[j], (x[pos + j], np.arange(FILTERS)[None, :]), gh)
            gt[:, PAD] = 0
            step += 1
            for p, grad, a1, a2 in zip(params, (gt, gw, gb), m1, m2):
                a1 += 0.1 * (grad - a1)
                a2 += 0.01 * (grad * grad - a2)
                p -= (RATE * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return {"tables": tables, "w": w, "b": bias}


def predict(model: dict, texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    if not raw:
        return np.zeros(0)
    x, starts, n = layout(raw)
    parts = []
    for a in range(0, len(starts), STEP):
        at = starts[a : a + STEP]
        parts.append(np.concatenate([np.maximum(convolve(x, at, model["tables"]).max(axis=1), 0), repeats(x, at)], axis=1))
    f, _ = combine(np.concatenate(parts), n)
    return sigmoid((f * model["w"]).sum(axis=1) + model["b"][0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> dict:
    """labels: only rows that may be learned from."""
    return train(labelled_sample(docs, labels, label, per_class, max_chars))


def score(docs: DataFrame, model: dict, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns plus the score under a name, for every row."""

    def run(texts):
        return [np.concatenate([predict(model, texts[a : a + 64]) for a in range(0, len(texts), 64)]) if texts else np.zeros(0)]

    return map_texts(docs, columns, run, f"{name} double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the labels of fold 1 of 3 are never learned from."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    rows = score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model, ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
