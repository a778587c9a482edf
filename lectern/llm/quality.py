"""Quality rules: gradient-boosted trees over document statistics (operator 1).

The trees are grown in numpy on a bounded sample of labelled rows, with monotonic
constraints on chosen statistics, and flattened into node arrays; scoring walks all rows
of a batch down each tree at once.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow
from lectern.session import run_arrow

#: Labelled rows that the trees are fitted on, at most (the smallest hashes of doc_id).
TRAIN_ROWS = 12_000
#: A document is rejected where its chance of being bad is this or more.
REJECT_AT = 0.5
SYMBOLS = "#*$%&|<>"
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_MARKS = b".,;:!?"

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "shout_per_word", "digit_share", "distinct_share", "marks_per_word", "words_per_line",
)
#: +1: the chance of being bad may only rise with it.
MONOTONE = {"symbols_per_word": 1, "dup_line_share": 1, "repeat_share": 1, "upper_share": 1, "shout_per_word": 1}


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, first ones included."""
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    covered = end = 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of the base rules, and FEATURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only, as the rules say
    joined = b"".join(words)
    chars = len(text) - (len(raw) - len(joined))
    symbols = sum(map(text.count, SYMBOLS))
    lines = dup = 0
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = repeat_words(words)
    n, c = max(len(words), 1), max(chars, 1)
    rest = len(joined)
    features = [
        float(np.log1p(len(words))), chars / n, symbols / n, dup / max(lines, 1), repeats / n,
        (rest - len(joined.translate(None, _UPPER))) / c, joined.count(b"!") / n,
        (rest - len(joined.translate(None, _DIGITS))) / c, len(set(words)) / n,
        (rest - len(joined.translate(None, _MARKS))) / n, len(words) / max(lines, 1),
    ]
    return [len(words), chars, symbols, dup, repeats], features


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            out += self.value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, bad: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> Trees | None:
    """Boosted trees of logistic loss with second-order gains; None where only one class is seen."""
    if not len(x) or bad.min() == bad.max():
        return None
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    cell = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    way = [MONOTONE.get(name, 0) for name in FEATURES]
    p0 = bad.mean()
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(x), base)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        sg, sh = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-sg / (sh + l2), low, high))
        nodes.append([-1, 0.0, me, me, rate * leaf])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and sh > 2 * least:
            whole = leaf * sg + 0.5 * (sh + l2) * leaf * leaf
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(cell[rows, f], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(cell[rows, f], h[rows], size))[:-1]
                wl = np.clip(-gl / (hl + l2), low, high)
                wr = np.clip(-(sg - gl) / (sh - hl + l2), low, high)
                gain = whole - (wl * gl + 0.5 * (hl + l2) * wl**2) - (wr * (sg - gl) + 0.5 * (sh - hl + l2) * wr**2)
                fits = (hl >= least) & (sh - hl >= least) & (way[f] * (wr - wl) >= 0)
                gain = np.where(fits, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        _, f, k, wl, wr = best
        if f < 0:
            margin[rows] += rate * leaf
            return me
        go = cell[rows, f] <= k
        middle = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[way[f]]
        nodes[me][0], nodes[me][1] = f, float(cuts[f][k])
        nodes[me][2] = grow(rows[go], g, h, level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~go], g, h, level + 1, *bounds[1])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), p - bad, p * (1 - p), 0, -np.inf, np.inf))
    feature, cut, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(np.array(roots), feature, cut, left, right, value, base, depth)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Fit on at most `rows` labelled documents.  Null labels and keys are left out; a
    document that is labelled twice counts as bad if one label says so."""
    sample = (
        labels.select(F.col("doc_id").alias("k"), F.col("quality").alias("q")).dropna()
        .groupBy("k").agg(F.min("q").alias("q")).orderBy(F.xxhash64("k"), "k").limit(rows)
    )
    # at most `rows` keys, a proven bound; a key that repeats counts once, by its least text
    found = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("k"))
    found = found.groupBy("k").agg(F.first("q").alias("q"), F.min("text").alias("text"))

    def make():
        def one(batch):
            return {"bad": [float(q < 1) for q in batch.column(1).to_pylist()], "x": [statistics(t)[1] for t in batch.column(2).to_pylist()]}

        return one

    got = map_arrow(found, "bad double, x array<double>", make).toPandas()
    got = sorted(zip(got.bad.tolist(), map(tuple, got.x)))  # the same sums in whatever order rows come
    return fit(np.array([x for _, x in got]), np.array([bad for bad, _ in got])) if got else None


def judge_quality(documents: DataFrame, trees: Trees | None, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, the five counts, base_failed, p_bad and kept for every row.

    Null and empty texts have no words and so fail the base rules.  Without a model (no
    labels, or labels of one class) p_bad is null and the base rules alone decide.
    Repeated rows are judged each; other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def one(batch):
            both = [statistics(t) for t in batch.column(1).to_pylist()]
            counts = np.array([c for c, _ in both], np.int64)
            failed = np.array([base_failed(c) for c, _ in both])
            p = trees.chance(np.array([f for _, f in both])) if trees else None
            kept = ~failed & (p < reject_at) if trees else ~failed
            return {
                "doc_id": batch.column(0), "n_words": counts[:, 0], "word_chars": counts[:, 1], "n_symbols": counts[:, 2], "n_dup_lines": counts[:, 3],
                "n_repeat_words": counts[:, 4], "base_failed": failed, "kept": kept, "p_bad": p if trees else [None] * len(both),
            }

        return one

    return map_arrow(
        documents.select("doc_id", "text"),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_bad double", make,
    )


def keep_good(documents: DataFrame, trees: Trees | None, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of documents, all columns, that the rules keep, in one pass without a join."""
    names = documents.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(documents.schema), names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both = [statistics(t) for t in batch.column(at).to_pylist()]
            if both:
                keep = ~np.array([base_failed(c) for c, _ in both])
                if trees:
                    keep &= trees.chance(np.array([f for _, f in both])) < reject_at
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.filter(pa.array(keep)).columns, arrow)], schema=arrow)

    return run_arrow(documents, run, documents.schema)
