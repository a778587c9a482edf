"""Substring deduplication by recompression (operator 6).

Every word gets a global name, its hash.  In three rounds adjacent names are paired: a
hash of the name puts it left or right, and a left name with a right one after it gets the
hash of both as its new name.  Whether two names pair depends on them alone, so equal
substrings get equal names inside, in every document and without any exchange.  (A run of
one name never pairs; giving it a name by its length would make that name depend on words
outside the window.)  A 20-word window always holds a third-round name, at most 8 words
long, that starts in its words 4 to 12; of these the one of least hash is the window's
anchor.  Spark counts the anchors' surroundings of 12 words over the corpus; only windows
whose anchor occurs again are compared, by 128-bit hashes, and all but the first
occurrence are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bit_blocks, bits_for, chunks, durable, has_bits, map_arrow
from lectern.session import run_arrow

WINDOW = 20
ROUNDS = 3
#: The words of a window in which its anchor may start, and an anchor's surroundings.
FIRST, LAST, BEFORE, AFTER = 4, 12, 4, 8
#: Bits of the filter of repeated anchors that executors get, at most.  More anchors are
#: handled in slices of the anchors, one pass each.
FILTER_BITS = 1 << 27
#: An anchor that occurs more often is dealt over SALTS places first.
HOT, SALTS = 1000, 63
_SALT = np.int64(63)
#: Characters handled at once in a worker.
CHUNK = 1_000_000
_C1, _C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def names_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the words of all texts: a name is the sum of a hash of each of the
    word's bytes with its place; bounds: where each text's words start and end."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    bounds = np.searchsorted(starts, edges).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    own = data[word]
    begin = np.flatnonzero(first[word])
    place = np.arange(len(own)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(own)]])))
    bytes_ = _mix(np.arange(1, 257).astype(np.uint64) * np.uint64(_C1))
    places = _mix(np.arange(1, place.max() + 2).astype(np.uint64) * np.uint64(_C2))
    return _mix(np.add.reduceat(_mix(bytes_[own] + places[place]), begin)), bounds


def compress(names: np.ndarray, stop: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(starts, names) after the rounds of pairing.  stop[i]: word i ends its document."""
    at = np.arange(len(names))
    for k in range(rounds):
        left = _mix(names + np.uint64(_C2 * (k + 1) & _M)) & np.uint64(1) != 0
        pair = np.zeros(len(names), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~stop[:-1]
        first = np.flatnonzero(pair)
        names = names.copy()
        names[first] = _mix(names[first] * np.uint64(_C1) + names[first + 1] * np.uint64(_C2) + np.uint64(k + 1))
        stop = stop.copy()
        stop[first] = stop[first + 1]
        keep = np.ones(len(names), bool)
        keep[first + 1] = False
        at, names, stop = at[keep], names[keep], stop[keep]
    return at, names


def rolling(names: np.ndarray, sizes: tuple[int, ...], base: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of so many words, by doubling; entry i starts at word i."""
    powers, done = {1: names}, {}
    n = 1
    while 2 * n <= max(sizes):
        p = powers[n]
        powers[2 * n] = p[:-n] * np.uint64(pow(base, n, 1 << 64)) + p[n:] if len(p) > n else p[:0]
        n *= 2
    for size in sizes:
        whole, have = None, 0
        for n in sorted(powers, reverse=True):
            if size - have >= n:
                p = powers[n][have:]
                whole = p if whole is None else whole[: len(p)] * np.uint64(pow(base, n, 1 << 64)) + p[: len(whole)]
                have += n
        done[size] = whole
    return done


def windows(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor): each window of WINDOW words inside a document, and the position of
    its anchor.  bounds: where documents start and end in `names`."""
    sizes = np.diff(bounds)
    n = len(names)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.zeros(n, bool)
    stop[bounds[1:][sizes > 0] - 1] = True
    at, symbols = compress(names, stop)
    low = np.uint64((1 << 24) - 1)
    value = np.full(n, _M, np.uint64)
    value[at] = (_mix(symbols) & ~low) | at.astype(np.uint64)  # of equal hashes the leftmost
    span = LAST - FIRST + 1
    best, size = value, 1
    while 2 * size <= span:
        best, size = np.minimum(best[:-size], best[size:]), 2 * size
    if span > size:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    end = np.repeat(bounds[1:], sizes)
    start = np.flatnonzero(np.arange(n) + WINDOW <= end)
    return start, (best[start + FIRST] & low).astype(np.int64)


def _anchored(texts: list[str | None]):
    """Per run of rows: first row, names, bounds, window starts, anchors, and the anchors' keys."""
    for a, b in chunks([len(t or "") + 1 for t in texts], CHUNK):
        own, bounds = names_of(texts[a:b])
        start, anchor = windows(own, bounds)
        if len(start):
            keys = rolling(own, (BEFORE + AFTER,), _C1)[BEFORE + AFTER]
            yield a, own, bounds, start, anchor, _mix(keys[anchor - BEFORE]).view(np.int64)


def anchors(documents: DataFrame) -> DataFrame:
    """(key) of every anchor of every document."""

    def make():
        def one(batch):
            out = [np.zeros(0, np.int64)]
            for _, _, _, _, anchor, keys in _anchored(batch.column(0).to_pylist()):
                out.append(keys[np.unique(anchor, return_index=True)[1]])
            return {"key": np.concatenate(out)}

        return one

    return map_arrow(documents.select("text"), "key long", make)


def repeated_windows(documents: DataFrame, repeated: np.ndarray, hot: np.ndarray, slices: int, piece: int) -> DataFrame:
    """(k1, k2, doc, pos) of the windows whose anchor is repeated.  The low bits of k2 hold
    the salt, 0 for windows that are not hot."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((repeated, hot))

    def make():
        columns = ("k1", "k2", "doc", "pos")

        def one(batch):
            filters = shared.value
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            out = [[np.zeros(0, np.int64)] for _ in columns]
            for a, own, bounds, start, anchor, keys in _anchored(batch.column(1).to_pylist()):
                again = has_bits(filters[0], keys)
                if slices > 1:
                    again &= (keys >> 32) % slices == piece
                start, keys = start[again], keys[again]
                row = np.searchsorted(bounds, start, side="right") - 1
                doc = docs[a + row].astype(np.int64)
                often = has_bits(filters[1], keys)
                salt = np.where(often, 1 + (_mix(doc.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                k1, k2 = (_mix(rolling(own, (WINDOW,), c)[WINDOW][start]).view(np.int64) for c in (_C1, _C2))
                for x, v in zip(out, (k1, k2 & ~_SALT | salt, doc, start - bounds[row])):
                    x.append(v)
            return {k: np.concatenate(v) for k, v in zip(columns, out)}

        return one

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc"), "text"), "k1 long, k2 long, doc long, pos int", make)


def later(rows: DataFrame) -> DataFrame:
    """Rows (k1, k2, doc, pos) to (doc, pos) of all but the first of each key, and, with k1
    and k2, the firsts that still have to meet those of other salts.

    One sorted pass; a task holds a batch and the first row of the key at hand.
    """

    def run(batches):
        import pyarrow as pa

        head = None  # k1, k2 and the first doc, pos of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc, pos = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            carried = head is not None and head[:2] == (k1[0], k2[0])
            new[0] = not carried
            at = np.maximum.accumulate(np.where(new, np.arange(len(k1)), -1))
            fd, fp = doc[at], pos[at]
            if carried:
                fd, fp = np.where(at < 0, head[2], fd), np.where(at < 0, head[3], fp)
            head = (k1[-1], k2[-1], fd[-1], fp[-1])
            gone = (doc != fd) | (pos != fp)
            pick = gone | new & (k2 & _SALT != 0)
            if pick.any():
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1[pick], mask=gone[pick]), pa.array(k2[pick] & ~_SALT, mask=gone[pick]), pa.array(doc[pick]), pa.array(pos[pick].astype(np.int32)),
                ], names=["k1", "k2", "doc", "pos"])

    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc", "pos")
    return run_arrow(dealt, run, "k1 long, k2 long, doc long, pos int")


def _slice(slices: int) -> F.Column:
    return F.pmod(F.shiftright("key", 32), F.lit(slices))


def repeats(documents: DataFrame, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(doc, pos): the starts of windows whose words also start earlier."""
    named = documents.filter(F.col("doc_id").isNotNull())
    counted = durable(anchors(named).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    n = counted.count()
    slices = max(1, -(-8 * n // filter_bits))
    often = counted.filter(F.col("n") > hot)
    busy = bit_blocks(often, "key", bits_for(often.count(), filter_bits))
    out = None
    for piece in range(slices):
        part = counted if slices == 1 else counted.filter(_slice(slices) == piece)
        filled = bit_blocks(part, "key", bits_for(-(-n // slices), filter_bits))
        first = durable(later(repeated_windows(named, filled, busy, slices, piece)))
        met = first.filter("k1 is not null").select("k1", "k2", "doc", "pos")
        found = first.filter("k1 is null").union(later(met)).select("doc", "pos")
        out = found if out is None else out.union(found)
    return out


def dedup_substrings(documents: DataFrame, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    A word goes if a window that covers it has the words of a window that starts earlier
    (smaller doc_id, or same document and earlier start).  Windows are judged on the input.
    Null and empty texts have no words; texts under 20 words have no window.  Rows that
    share a doc_id are one document.  Rows without a doc_id lose nothing and take nothing.
    Other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    gone = repeats(documents, filter_bits, hot).groupBy("doc").agg(F.collect_list("pos").alias("starts"))  # a document's own windows
    rows = documents.select("doc_id", "text").join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "starts")

    def make():
        def one(batch):
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_text": []}
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = (text or "").encode().split()
                removed = 0
                if starts.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(starts.values.to_numpy())
                    change[at] += 1
                    change[at + WINDOW] -= 1
                    stay = np.cumsum(change[:-1]) == 0
                    removed = int(len(words) - stay.sum())
                    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
                else:
                    kept = words
                out["n_words"].append(len(words)), out["n_removed"].append(removed), out["kept_text"].append(b" ".join(kept).decode())
            return out

        return one

    return map_arrow(rows, f"doc_id {kind}, n_words long, n_removed long, kept_text string", make)
