"""Toxicity by class-conditional Kneser-Ney models (operator 4).

Two character 5-gram models, of toxic and of ordinary text, discount their own counts and
back off to one shared Kneser-Ney model of all counts.  A document's score compares their
length-normalised log-likelihoods, over the whole text and over the passage where they
differ most (a few words make a text toxic, and the longer it is the less they weigh in the
whole); a logistic curve turns the two comparisons into a chance.  All labelled training texts are counted, by Spark, and
every n-gram of them is in the models: the tables of driver and executors grow with the
number of distinct n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks, durable, if_small, map_arrow
from lectern.session import run_arrow

ORDER = 5
#: Bits of a character in a packed n-gram; code points beyond are hashed into them.
CHAR_BITS = 12
#: Labelled rows that the final logistic curve is fitted on, at most.
CURVE_ROWS = 8_000
#: Characters of the window whose mean is a document's strongest passage.
SPAN = 12
#: Ordinary documents called toxic that weigh as much as one toxic document missed.
MISSED = 3.0
FOLDS = 5
#: Occurrences of a context that the shared model counts for in each class, so that an
#: expression seen once or twice says little.
SHARED = 4.0
#: Characters handled at once in a worker.
CHUNK = 1_000_000
_PAD = 1  # stands before a text, ORDER - 1 times
_LOW = np.int64((1 << (CHAR_BITS * (ORDER - 1))) - 1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams, one for each character, of all texts, and the texts' bounds."""
    joined = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in joined], np.int64)
    pad = chr(_PAD) * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in joined).encode("utf-32-le"), np.uint32).astype(np.int64)
    top = (1 << CHAR_BITS) - 1
    codes = np.where(codes <= top, codes, ((codes * 2654435761) >> 9) & top)
    whole = codes[ORDER - 1 :].copy()
    for i in range(1, ORDER):
        whole |= codes[ORDER - 1 - i : len(codes) - i] << (CHAR_BITS * i)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # position of each text's characters in `whole`: the pads of the texts after the first lie between
    own = np.arange(bounds[-1]) + np.repeat(np.arange(len(sizes)) * (ORDER - 1), sizes)
    return whole[own], bounds


def count_grams(texts: DataFrame) -> DataFrame:
    """(text, toxic, part) to (gram, tox, ord, tox0, ord0): counts over all rows; those
    ending in 0 are over the rows with part = 0."""

    def run(batches):
        import pyarrow as pa

        names = ["gram", "tox", "ord", "tox0", "ord0"]
        held = np.zeros((0, 5), np.int64)

        def merge(rows):
            keys, at = np.unique(rows[:, 0], return_inverse=True)
            out = np.zeros((len(keys), 5), np.int64)
            out[:, 0] = keys
            for c in range(1, 5):
                out[:, c] = np.bincount(at, rows[:, c], len(keys)).astype(np.int64)
            return out

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=names)

        for batch in batches:
            text, toxic, part = (batch.column(i).to_pylist() for i in range(3))
            for a, b in chunks([len(t or "") + 8 for t in text], CHUNK):
                g, bounds = grams(text[a:b])
                flags = np.repeat(2 * np.array(toxic[a:b], np.int64) + (np.array(part[a:b]) == 0), np.diff(bounds))
                new = []
                for kind in range(4):
                    keys, n = np.unique(g[flags == kind], return_counts=True)
                    rows = np.zeros((len(keys), 5), np.int64)
                    rows[:, 0] = keys
                    rows[:, 1 if kind >= 2 else 2] = n
                    if kind % 2:
                        rows[:, 3 if kind >= 2 else 4] = n
                    new.append(rows)
                held = merge(np.concatenate([held, *new]))
                if len(held) > 1_000_000:
                    yield table(held)
                    held = held[:0]
        if len(held):
            yield table(held)

    made = texts.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("part").cast("int").alias("part"))
    out = run_arrow(made, run, "gram long, tox long, ord long, tox0 long, ord0 long")
    return out.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("tox", "ord", "tox0", "ord0")])


@dataclass
class Model:
    """Log-likelihood ratio of each seen gram, and of unseen ones by context."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def ratios(self, g: np.ndarray) -> np.ndarray:
        out, missed = _get(self.levels, g)
        if len(missed):
            out[missed] = _get(self.contexts, g[missed] >> CHAR_BITS)[0]
        return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)).astype(np.int64)


def _levels(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Open tables: what finds its place taken goes to the next, smaller table."""
    out = []
    while len(keys):
        size = max(4, (2 * len(keys) - 1).bit_length())
        at = _slots(keys, size)
        k, v = np.full(1 << size, -1, np.int64), np.zeros(1 << size, np.float32)
        k[at], v[at] = keys, values
        lost = k[at] != keys
        out.append((k, v))
        keys, values = keys[lost], values[lost]
    return out


def _get(levels, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(g), np.float32)
    missed = np.arange(len(g))
    for k, v in levels:
        own = g[missed]
        at = _slots(own, len(k).bit_length() - 1)
        hit = k[at] == own
        out[missed[hit]] = v[at[hit]]
        missed = missed[~hit]
    return out, missed


def _discount(counts: np.ndarray) -> float:
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def _sums(keys: np.ndarray, counts: np.ndarray):
    """Distinct keys, and the sum and number of positive counts of each, and each row's place."""
    distinct, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, counts, len(distinct)), np.bincount(at, counts > 0, len(distinct)), at


def shared_model(suffix: np.ndarray, continuations: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each suffix's last character, from the number
    of distinct characters before each suffix, down to single characters."""
    if not len(suffix):
        return np.zeros(0)
    order = ORDER - 1
    keys, counts = [suffix], [continuations.astype(np.float64)]
    for n in range(order - 1, 0, -1):
        short, number = np.unique(keys[-1] & ((1 << (CHAR_BITS * n)) - 1), return_counts=True)
        keys.append(short), counts.append(number.astype(np.float64))
    p = np.full(len(keys[-1]), 1 / (len(keys[-1]) + 1))
    for n in range(1, order + 1):
        key, count = keys[order - n], counts[order - n]
        total, types, at = _sums(key >> CHAR_BITS, count)
        d = _discount(count)
        lower = p if n == 1 else p[np.searchsorted(keys[order - n + 1], key & ((1 << (CHAR_BITS * (n - 1))) - 1))]
        p = np.maximum(count - d, 0) / total[at] + d * types[at] / total[at] * lower
    return p


def build(gram: np.ndarray, tox: np.ndarray, ord_: np.ndarray) -> Model:
    """The ratio tables from the counts of all grams (sorted by gram)."""
    if not tox.sum() or not ord_.sum():
        return Model([], [])
    suffix, inverse, number = np.unique(gram & _LOW, return_inverse=True, return_counts=True)
    base = shared_model(suffix, number)[inverse]
    context = gram >> CHAR_BITS
    both = (tox + ord_).astype(np.float64)
    total, types, at = _sums(context, both)
    d = _discount(both)
    pooled = np.maximum(both - d, 0) / total[at] + d * types[at] / total[at] * base
    logs, weights = [], []
    for c in (tox.astype(np.float64), ord_.astype(np.float64)):
        total, types, at = _sums(context, c)
        d = _discount(c[c > 0])
        back = np.where(total > 0, (d * types + SHARED) / (total + SHARED), 1.0)
        own = np.maximum(c - d, 0) / (total[at] + SHARED)
        logs.append(np.log(own + back[at] * pooled))
        weights.append(np.log(back))
    # a gram that neither class has says what its context's two back-off weights say, if less toxic
    unseen = np.minimum(weights[0] - weights[1], 0.0)
    return Model(_levels(gram, (logs[0] - logs[1]).astype(np.float32)), _levels(np.unique(context), unseen.astype(np.float32)))


def compare(model: Model, texts: list[str | None]) -> np.ndarray:
    """Per text: the toxic model's log-likelihood less the ordinary one's, a character, of
    the whole text, and of the SPAN characters in a row where that is largest (of a shorter
    text: all); zeros for an empty text."""
    out = np.zeros((len(texts), 2))
    for a, b in chunks([len(t or "") + 8 for t in texts], CHUNK):
        g, bounds = grams(texts[a:b])
        if not len(g):
            continue
        sums = np.concatenate([[0.0], np.cumsum(model.ratios(g).astype(np.float64))])
        n = np.diff(bounds)
        rows = np.flatnonzero(n)
        out[a + rows, 0] = (sums[bounds[1:]] - sums[bounds[:-1]])[rows] / n[rows]
        for i in rows.tolist():
            s = sums[bounds[i] : bounds[i + 1] + 1]
            out[a + i, 1] = ((s[SPAN:] - s[:-SPAN]) if n[i] > SPAN else s[-1:] - s[0]).max() / SPAN
    return out


@dataclass
class Scorer:
    model: Model
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (compare(self.model, texts) - self.middle) / self.scale
        z = np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def _curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on the standardised comparisons."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    a = np.concatenate([np.ones((len(x), 1)), (x - middle) / scale], 1)
    w, weigh = np.zeros(a.shape[1]), np.where(y > 0, MISSED, 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weigh * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weigh * (y - p)) - l2 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w, middle, scale


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def train(documents: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> Scorer | None:
    """Learn from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    All of them are counted.  The curve from ratios to a score is fitted on documents of
    fold 1 (a bounded sample) with a model of the other folds, so that no document is
    judged by its own counts; the counts of all training folds then make the model in use.
    None without rows of both classes.  Null labels and keys are left out; a document that
    is labelled twice is toxic if one label says so.
    """
    known = labels.select("doc_id", F.col("toxic").alias("t")).dropna().filter(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("t").alias("toxic"))
    texts = documents.select("doc_id", "text").filter(fold() != 0).join(if_small(known), "doc_id").withColumn("part", (fold() == 1).cast("int"))
    counts = durable(count_grams(texts))
    # part 1 is the curve's fold: tox0 and ord0 are the counts without it
    every = counts.toArrow().sort_by("gram")
    gram, tox, ord_, tox0, ord0 = (every[c].to_numpy() for c in ("gram", "tox", "ord", "tox0", "ord0"))
    if not len(gram) or not tox.sum() or not ord_.sum():
        return None
    here = tox0 + ord0 > 0
    trial = build(gram[here], tox0[here], ord0[here])
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(trial)
    sample = known.filter(fold() == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(curve_rows)

    def make():
        def one(batch):
            x = compare(shared.value, batch.column(1).to_pylist())
            return {"toxic": batch.column(2).cast("float64"), "x": list(x)}

        return one

    # a key that repeats counts once, by its least text: at most `curve_rows` rows reach the driver
    rows = documents.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(sample), F.col("d") == F.col("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    got = map_arrow(rows, "toxic double, x array<double>", make).toPandas()
    got = sorted(zip(got.toxic.tolist(), map(tuple, got.x)))  # the same sums in whatever order rows come
    y = np.array([t > 0 for t, _ in got], float)
    if 0 < y.sum() < len(y):
        weights, middle, scale = _curve(np.array([x for _, x in got]), y)
    else:
        weights, middle, scale = np.array([0.0, 1.0, 0.0]), np.zeros(2), np.full(2, 0.05)  # the whole text alone
    return Scorer(build(gram, tox, ord_), weights, middle, scale)


def score_toxicity(documents: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have ratio 0 throughout and get the score of that.  Without a
    model every score is 0.  Repeated rows are scored each; other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def make():
        def one(batch):
            texts = batch.column(1).to_pylist()
            s = shared.value.scores(texts) if shared.value else np.zeros(len(texts))
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return one

    return map_arrow(
        documents.select("doc_id", "text", (F.coalesce(fold() == 0, F.lit(False))).alias("held_out")),
        f"doc_id {kind}, held_out boolean, score double, predicted int", make,
    )
