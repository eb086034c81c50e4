"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics come from the whole text alone. The trees are fitted on the driver over a bounded
sample of labelled rows and flattened into arrays, through which a task walks all rows and all
trees of a batch at once.

Nulls and edge cases: a null text counts as empty, and empty texts have statistics of zero and hence
a score; rows without a label are scored but not learned from, and so are labels that are null; of
several labels for an id the mean counts, and of several texts the one with the smallest statistics; where nothing is learned the score is 0.5; equal texts get
equal scores; texts may be of any length; ids may be null or repeated; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import map_texts

#: Labelled rows that a fit uses at most: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000

_KINDS = ["letters", "capitals", "digits", "spaces", "lines", "stops", "commas", "bars", "marks", "symbols", "quotes", "above_ascii"]
_MEMBERS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\r",
    "lines": b"\n", "stops": b".", "commas": b",;:", "bars": b"|<>{}[]/\\=_", "marks": b"!?", "symbols": b"#$%&*@^~+", "quotes": b"\"'()`-", "above_ascii": bytes(range(128, 256)),
}
STATISTICS = [*_KINDS, "chars", "words", "mean_word", "longest_word", "distinct_words", "top_word", "word_repeats", "line_count", "distinct_lines", "top_line", "entropy", "distinct_pairs"]


def _classes() -> np.ndarray:
    table = np.zeros((256, len(_KINDS)))
    for k, name in enumerate(_KINDS):
        table[list(_MEMBERS[name]), k] = 1
    return table


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    bytes_ = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).reshape(-1, 256)
    total = np.maximum(bytes_.sum(1), 1)
    share = bytes_ / total[:, None]
    k = len(_KINDS)
    out[:, :k] = share @ _classes()
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            continue
        seen = Counter(words)
        lines = Counter([x for x in t.split(b"\n") if x.strip()])
        m = lines.total()
        sizes = list(map(len, words))
        out[i, k : k + 10] = (
            np.log1p(len(t)), np.log1p(n), sum(sizes) / n, max(sizes), len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n,
            np.log1p(m), len(lines) / m, max(lines.values()) / m,
        )
        out[i, k + 11] = len(set(zip(words, words[1:]))) / n  # noqa: B905
    out[:, k + 10] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return out


@dataclass
class Trees:
    """Complete trees of one depth: node j of a tree goes on to 2j + 1, or 2j + 2 where its feature is above its threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows, tree = np.arange(len(part))[:, None], np.arange(trees)[None, :]
            at = np.zeros((len(part), trees), np.int64)
            while at[0, 0] < inner:
                at = 2 * at + 1 + (part[rows, self.feature[tree, at]] > self.threshold[tree, at])
            out[a : a + 4096] = self.base + self.leaf[tree, at - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boosting of the logistic loss with second-order leaves, over histograms of binned features."""
    inner, n = 2**depth - 1, len(x)
    if not n:
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-9
        at = np.zeros(n, np.int64)  # place in the level
        for d in range(depth):
            width, first = 2**d, 2**d - 1
            best, cut = np.full(width, 1e-6), np.full(width, -1)
            which = np.zeros(width, np.int64)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                m = len(e) + 1
                key = at * m + binned[:, f]
                gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = -1
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], cut[better], which[better] = value[better], top[better], f
            split = cut >= 0
            feature[r, first : first + width][split] = which[split]
            threshold[r, first : first + width][split] = [edges[f][c] for f, c in zip(which[split], cut[split], strict=True)]
            # x <= edges[c] is the same as binned <= c.
            go = split[at] & (binned[np.arange(n), which[at]] > cut[at])
            at = 2 * at + go
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf[r] = rate * gs / (hs + ridge)
        margin += leaf[r][at]
    return Trees(base, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most rows labelled documents."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")  # at most rows ids and numbers

    def make():
        return lambda batch: [list(statistics(batch))]

    # Of several texts of an id the one with the smallest statistics counts, so that no more than rows come to the driver.
    found = map_texts(texts, ["id", "y"], "text", "x array<double>", make).groupBy("id").agg(F.min(F.struct("y", "x")).alias("m")).select("id", "m.y", "m.x").toPandas().sort_values("id")
    if found.empty:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.stack(found.x.to_numpy()), found.y.to_numpy())


def score(docs: DataFrame, trees: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns kept with score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # of fixed size

    def make():
        return lambda batch: [sent.value.probability(statistics(batch))]

    return map_texts(docs, keep, text_col, "score double", make)
