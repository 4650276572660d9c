"""Benchmark decontamination by a prefix-filtered containment join.

A window is ``size`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window).  A document contains a window only if it
contains every shingle of it, so it is enough to join on the window's prefix:
its rarest shingle, by counts over all documents.  Each joined pair then
passes a positional bound (where the window would start) and a length bound
(the document must have room for it) before its words are compared one by
one.

Nulls and empty texts have no words: such a document has no hits and is not
contaminated, such an item has no window.  Items with a null id take no part.
Repeated item ids are one item, repeated documents each get their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.shared import Sent, cut, extended, text_key

WINDOW = 13
SHINGLE = 3
#: Benchmark text that is sent to tasks at once; a larger benchmark is worked through in blocks.
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20


@dataclass
class Windows:
    """Windows of a benchmark block: first word, length, item, words joined by a space, and all its words' hashes."""

    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    hash: np.ndarray
    text: list
    word: np.ndarray


def windows_of(texts: list, size: int) -> Windows:
    start, length, item, text, word, base = [], [], [], [], [], 0
    for row, _, data, offsets in W.pieces(pa.array(texts, pa.string()), limit=0):
        w = W.split_words(data, offsets, W.plain_words())
        n, low = len(w.hash), W.lowered()[data].tobytes()
        k = min(size, n)
        for i in range(n - k + 1 if n else 0):
            start.append(base + i)
            length.append(k)
            item.append(row)
            text.append(b" ".join(low[a:b] for a, b in zip(w.start[i:i + k], w.end[i:i + k])))
        word.append(w.hash)
        base += n
    word = np.concatenate(word) if word else np.zeros(0, np.uint64)
    start, length = np.array(start, np.int64), np.array(length, np.int64)
    hashed = np.zeros(len(start), np.uint64)
    for k in np.unique(length):
        at = np.flatnonzero(length == k)
        hashed[at] = W.runs(word, int(k))[start[at]]
    return Windows(start, length, np.array(item, np.int64), hashed, text, word)


def shingles_of(win: Windows, most: int) -> list[tuple[int, np.ndarray]]:
    """(shingle length, its hashes at each word) for the shingle lengths that the windows need."""
    return [(int(k), W.runs(win.word, int(k))) for k in np.unique(np.minimum(win.length, most))]


def bit_filter(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return seen


def found(values: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` that hold one of the sorted ``keys``, and which key."""
    at = np.flatnonzero(seen[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    if not len(at) or not len(keys):
        return at[:0], at[:0]
    which = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    same = keys[which] == values[at]
    return at[same], which[same]


def shingle_counts(docs: DataFrame, keys_by_length: list) -> dict[int, np.ndarray]:
    """How often each benchmark shingle occurs in all documents."""
    shared = Sent(docs.sparkSession, keys_by_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        seen = [bit_filter(keys) for _, keys in lists]
        totals = [np.zeros(len(keys), np.int64) for _, keys in lists]
        for batch in batches:
            for _, _, data, offsets in W.pieces(batch.column(0)):
                w = W.split_words(data, offsets, W.plain_words())
                for (k, keys), s, total in zip(lists, seen, totals):
                    values = W.runs(w.hash, k)
                    at, which = found(values, keys, s)
                    inside = at + k <= w.at[np.searchsorted(w.at, at, "right")]
                    np.add.at(total, which[inside], 1)
        for (k, _), total in zip(lists, totals):
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int64()),
                                                  pa.array(total[some], pa.int64())], ["k", "place", "n"])

    rows = (docs.select("text").mapInArrow(count, "k int, place bigint, n bigint")
            .groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas())
    out = {k: np.zeros(len(keys), np.int64) for k, keys in keys_by_length}
    for k, part in rows.groupby("k"):
        out[int(k)][part["place"].to_numpy()] = part["n"].to_numpy()
    shared.unpersist()
    return out


@dataclass
class Prefixes:
    """For one shingle length: sorted prefix shingles, and the windows of each with the shingle's place inside."""

    k: int
    keys: np.ndarray
    at: np.ndarray
    window: np.ndarray
    place: np.ndarray


def prefixes(win: Windows, shingles: list, counts: dict[int, np.ndarray], most: int) -> list[Prefixes]:
    out = []
    for k, values in shingles:
        keys = np.unique(values)
        rarity = counts[k][np.searchsorted(keys, values)] if len(values) else np.zeros(0, np.int64)
        mine = np.flatnonzero(np.minimum(win.length, most) == k)
        place = np.zeros(len(mine), np.int64)
        for length in np.unique(win.length[mine]):
            sub = np.flatnonzero(win.length[mine] == length)
            span = win.start[mine[sub]][:, None] + np.arange(length - k + 1)[None, :]
            place[sub] = np.argmin(rarity[span], axis=1)
        key = values[win.start[mine] + place]
        order = np.argsort(key, kind="stable")
        uniq, first = np.unique(key[order], return_index=True)
        out.append(Prefixes(k, uniq, np.append(first, len(order)), mine[order], place[order]))
    return out


def contained(w: W.Words, index: list[Prefixes], seen: list, win: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every window that occurs in a text of the piece."""
    starts, which = [], []
    low = None
    for p, s in zip(index, seen):
        at, key = found(W.runs(w.hash, p.k), p.keys, s)
        if not len(at):
            continue
        many = p.at[key + 1] - p.at[key]
        slot = np.repeat(p.at[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
        window, first = p.window[slot], np.repeat(at, many) - p.place[slot]
        text = np.searchsorted(w.at, np.repeat(at, many), "right") - 1
        fits = (first >= w.at[text]) & (first + win.length[window] <= w.at[text + 1])
        window, first = window[fits], first[fits]
        for length in np.unique(win.length[window]):
            sub = np.flatnonzero(win.length[window] == length)
            a, x = first[sub], window[sub]
            sums = np.zeros(len(a), np.uint64)
            for j, c in enumerate(W.odd_numbers(int(length), 7)):
                sums += w.hash[a + j] * c
            same = W.mix(sums) == win.hash[x]
            for f, x in zip(a[same], x[same]):
                low = W.lowered()[w.data].tobytes() if low is None else low
                if b" ".join(low[c:d] for c, d in zip(w.start[f:f + length], w.end[f:f + length])) == win.text[x]:
                    starts.append(f)
                    which.append(x)
    return np.array(starts, np.int64), np.array(which, np.int64)


def spans_of(batch_text, index, seen, win: Windows) -> Iterator[tuple[int, int, list, list]]:
    """(row, words, merged word ranges that are hit, items) of each text."""
    for row, _, data, offsets in W.pieces(batch_text):
        w = W.split_words(data, offsets, W.plain_words())
        first, which = contained(w, index, seen, win)
        text = np.searchsorted(w.at, first, "right") - 1
        order = np.lexsort((first, text))
        first, which, text = first[order], which[order], text[order]
        bounds = np.searchsorted(text, np.arange(len(w.at)))
        for t in range(len(w.at) - 1):
            a, b = bounds[t], bounds[t + 1]
            ranges: list = []
            for f, x in zip(first[a:b] - w.at[t], which[a:b]):
                if ranges and f <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], int(f + win.length[x]))
                else:
                    ranges.append([int(f), int(f + win.length[x])])
            yield row + t, int(w.at[t + 1] - w.at[t]), ranges, sorted({int(i) for i in win.item[which[a:b]]})


def hit_columns(n_words: int, ranges: list, items) -> tuple:
    hit = sum(b - a for a, b in ranges)
    names = sorted(items)
    return (n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words)


COLUMNS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def block_index(docs: DataFrame, items: list, size: int, shingle: int):
    """What tasks need of one benchmark block; ``items``: (id as string, text)."""
    win = windows_of([t or "" for _, t in items], size)
    shingles = shingles_of(win, shingle)
    counts = shingle_counts(docs, [(k, np.unique(v)) for k, v in shingles]) if len(win.start) else {k: None for k, _ in shingles}
    index = prefixes(win, shingles, counts, shingle) if len(win.start) else []
    return Sent(docs.sparkSession, (index, win, [i for i, _ in items]))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE,
         block_bytes: int = BLOCK_BYTES, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated appended (named with ``prefix``).

    ``keep`` names the columns of ``docs`` to carry; all if None.

    The benchmark is sent to tasks in blocks of at most about ``block_bytes``
    of text, whose size is counted first.  One block, the usual case, needs no
    shuffle.  With more, each block's hits are kept by digest of the text and
    merged, so memory never holds the whole benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), "text").distinct()
    nbytes = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    blocks = max(1, -(-nbytes // block_bytes))
    names = [f"{prefix}{c.split()[0]}" for c in COLUMNS.split(", ")]
    kept = docs.columns if keep is None else keep
    schema = docs.select(*kept).schema
    extra = ", ".join(f"`{n}` {c.split()[1]}" for n, c in zip(names, COLUMNS.split(", ")))
    if blocks == 1:
        sent = block_index(docs, [tuple(r) for r in items.collect()], size, shingle)
        docs_at = {c: i for i, c in enumerate(docs.columns)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, win, ids = sent.value
            seen = [bit_filter(p.keys) for p in index]
            for batch in batches:
                rows = [hit_columns(n, ranges, {ids[i] for i in which})
                        for _, n, ranges, which in spans_of(batch.column(docs_at["text"]), index, seen, win)]
                cols = list(zip(*rows)) if rows else [[]] * len(TYPES)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(docs_at[c]) for c in kept), *(pa.array(list(c), t) for c, t in zip(cols, TYPES))],
                    [*kept, *names])

        return docs.mapInArrow(run, extended(schema, extra))
    keyed = cut(docs.select(*text_key(), "text").dropDuplicates(["k1", "k2"]))
    parts = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        sent = block_index(docs, [tuple(r) for r in mine.collect()], size, shingle)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, win, ids = sent.value
            seen = [bit_filter(p.keys) for p in index]
            for batch in batches:
                got = list(spans_of(batch.column(2), index, seen, win))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([n for _, n, _, _ in got], pa.int64()),
                    pa.array([[x for r in ranges for x in r] for _, _, ranges, _ in got], pa.list_(pa.int64())),
                    pa.array([[ids[i] for i in which] for _, _, _, which in got], pa.list_(pa.string()))],
                    ["k1", "k2", "n", "ranges", "items"])

        part = cut(keyed.mapInArrow(run, "k1 bigint, k2 bigint, n bigint, ranges array<bigint>, items array<string>"))
        sent.unpersist()
        parts = part if parts is None else parts.unionByName(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ranges: list = []
                for a, b in sorted((x[i], x[i + 1]) for x in r["ranges"] for i in range(0, len(x), 2)):
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], b)
                    else:
                        ranges.append([a, b])
                rows.append(hit_columns(r["n"], ranges, {i for x in r["items"] for i in x}))
            cols = list(zip(*rows)) if rows else [[]] * len(TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, TYPES))],
                                             ["__llm_k1", "__llm_k2", *names])

    merged = cut(parts.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.collect_list("ranges").alias("ranges"),
                                           F.collect_list("items").alias("items"))
                 .mapInArrow(merge, f"__llm_k1 bigint, __llm_k2 bigint, {extra}"))
    k1, k2 = text_key()
    return (docs.withColumns({"__llm_k1": k1, "__llm_k2": k2}).join(merged, ["__llm_k1", "__llm_k2"])
            .select(*kept, *names))

