"""Substring dedup by sliding sentence spans.

A sentence ends at a line end, after a word that ends in ``.``, ``!``,
``?`` or a like mark of another script (closing quotes and brackets may
follow), and after any word whose hash is a multiple of ``ANCHOR``: the last
rule depends on the word alone, so text without punctuation is cut at the same
places wherever it is copied to.  A passage without punctuation that has only
a few different words may hold none of these.  Words are what spaces part: a
mark inside a word, as in Chinese, ends nothing.  A
span is the shortest run of at least ``RUN`` sentences from a sentence on that
has ``LEAST`` words or more.  Spans are compared by 128-bit hashes of their
lower-cased words.

A span is first in the document of smallest doc_id that holds it, at its
first place there; every other occurrence is non-first, and the sentences
it covers are removed.

One scan counts each document's distinct span hashes globally (combined
before the shuffle); a second keeps, by a bitmap of fixed size, only spans
whose hash may repeat, and joins those exactly.  A passage that very many
documents hold is one row per document there, and the join is split where it
is hot.

Nulls and empty texts have no sentences and stay as they are.  Texts shorter
than a span are kept.  Rows that share a doc_id count as one document for
"first", and each loses its repeats.  Rows with a null id lose only repeats
inside their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.shared import bitmap_has, cut, hash_bitmap

RUN = 2
LEAST = 16
ANCHOR = 4
#: Sentence marks beyond ASCII, and closing quotes and brackets.
STOPS = "。！？．｡…‼⁇⁈⁉؟۔।॥։።፧፨།༎၊။។៕᠃᠉"
CLOSING = "\"')]”’»›」』）】》〉"
SEED = np.uint64(0x5851F42D4C957F2D)


def coded(marks: str) -> dict[int, np.ndarray]:
    """UTF-8 bytes of the characters as numbers, by length."""
    out: dict[int, list] = {}
    for c in marks:
        out.setdefault(len(c.encode()), []).append(int.from_bytes(c.encode(), "big"))
    return {n: np.array(v, np.int64) for n, v in out.items()}


def mark_length(w: W.Words, last: np.ndarray, marks: dict[int, np.ndarray]) -> np.ndarray:
    """Bytes of the mark that ends at byte ``last`` of each word, or 0."""
    out = np.zeros(len(last), np.int64)
    code = np.zeros(len(last), np.int64)
    for n in range(1, max(marks) + 1):
        code = code | (w.data[np.maximum(last - n + 1, 0)].astype(np.int64) << (8 * (n - 1)))
        if n in marks:
            out[np.isin(code, marks[n]) & (last - n + 1 >= w.start)] = n
    return out


def sentence_ends(w: W.Words) -> np.ndarray:
    """For each word whether a sentence ends after it."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, bool)
    closing, stop = coded(CLOSING), coded("!.?" + STOPS)
    last = w.end - 1
    while True:
        step = mark_length(w, last, closing)
        step[last - step < w.start] = 0
        if not step.any():
            break
        last = last - step
    lines = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data == 10) | (w.data == 13), out=lines[1:])
    following = np.append(w.start[1:], len(w.data))
    out = (mark_length(w, last, stop) > 0) | (lines[following] > lines[w.end]) | (w.hash % np.uint64(ANCHOR) == 0)
    out[w.at[1:][w.at[1:] > w.at[:-1]] - 1] = True
    return out


def spans_of(w: W.Words):
    """Sentences and spans of one piece.

    (sentence range of each text, first word of each sentence and one more,
    span's last sentence + 1 for each sentence or 0 if it has none, two
    64-bit hashes of each span).
    """
    begin = np.append(0, np.flatnonzero(sentence_ends(w)) + 1)
    at = np.searchsorted(begin, w.at)
    m = len(begin) - 1
    text_end = np.repeat(at[1:], np.diff(at))
    i = np.arange(m)
    stop = np.maximum(np.searchsorted(begin, begin[:-1] + LEAST), i + RUN)
    stop = np.where(stop <= text_end, stop, 0)
    power, inverse = W.powers(len(w.hash) + 1)
    hashes = []
    for salt in (np.uint64(0), SEED):
        total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(W.mix(w.hash ^ salt) * power[:len(w.hash)], out=total[1:])
        size = (begin[stop] - begin[:-1]).astype(np.uint64)
        hashes.append(W.mix((total[begin[stop]] - total[begin[:-1]]) * inverse[begin[:-1]] + size))
    return at, begin, stop, hashes


def first_places(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each span is the first of its hash in its text."""
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    out = np.ones(len(h1), bool)
    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    out[order[1:][same]] = False
    return out


def scan(docs: DataFrame, maybe=None) -> DataFrame:
    """(h1, h2, doc_id, digest, place) of the distinct spans of each text (doc_id, text, digest); with a bitmap, those
    whose hash may be in it."""
    sent = docs.sparkSession.sparkContext.broadcast(maybe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, _, data, offsets in W.pieces(batch.column(1)):
                w = W.split_words(data, offsets, W.spaced_words())
                at, _, stop, (h1, h2) = spans_of(w)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                ok = stop > 0
                if sent.value is not None:
                    ok &= bitmap_has(sent.value, h1.view(np.int64))
                rows = np.flatnonzero(ok)
                order = rows[np.lexsort((rows, h2[rows], h1[rows], text[rows]))]
                if len(order) > 1:
                    p, q = order[1:], order[:-1]
                    keep = np.append(True, (h1[p] != h1[q]) | (h2[p] != h2[q]) | (text[p] != text[q]))
                    order = order[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[order].view(np.int64)), pa.array(h2[order].view(np.int64)), pa.array(ids[a + text[order]]),
                     pa.array(digests[a + text[order]]), pa.array((order - at[text[order]]).astype(np.int32))], ["h1", "h2", "doc_id", "digest", "place"])

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, digest bigint, place int")


def repeated_places(docs: DataFrame) -> DataFrame:
    """(id, digest, places): the spans of each text that an earlier document holds too, by their first sentence."""
    docs = docs.filter("doc_id is not null")
    repeated = cut(scan(docs).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .filter("first < last").select("h1", "h2", "first"))
    hits = (scan(docs, hash_bitmap(repeated, "h1")).join(repeated, ["h1", "h2"]).filter("doc_id > first"))
    return cut(hits.groupBy(F.col("doc_id").alias("id"), "digest").agg(F.collect_set("place").alias("places")))


def removed(texts, places: list) -> Iterator[tuple[int, list, str | None]]:
    """(sentences, removed code point ranges, text that is left) of each text of an Arrow column."""
    for row, _, data, offsets in W.pieces(texts):
        w = W.split_words(data, offsets, W.spaced_words())
        at, begin, stop, (h1, h2) = spans_of(w)
        raw = data.tobytes()
        byte = np.append(w.start, len(data))[begin]
        for t in range(len(at) - 1):
            a, b = at[t], at[t + 1]
            has = stop[a:b] > 0
            again = np.zeros(b - a, bool)
            if has.any():
                spot = np.flatnonzero(has)
                again[spot[~first_places(h1[a:b][spot], h2[a:b][spot])]] = True
            listed = places[row + t]
            if listed:
                other = np.isin(h1[a:b], h1[a + np.array(listed)]) & has
                again |= other
            change = np.zeros(b - a + 1, np.int64)
            np.add.at(change, np.flatnonzero(again), 1)
            np.add.at(change, stop[a:b][again] - a, -1)
            gone = np.cumsum(change)[:b - a] > 0
            if not gone.any():
                yield b - a, [], raw[offsets[t]:offsets[t + 1]].decode()
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            cuts, parts, last = [], [], int(offsets[t])
            for x, y in zip(edge[::2], edge[1::2]):
                lo = int(byte[a + x])
                hi = int(byte[a + y]) if a + y < b else int(offsets[t + 1])
                parts.append(raw[last:lo])
                cuts.append((lo, hi, int(y - x)))
                last = hi
            parts.append(raw[last:offsets[t + 1]])
            ranges, seen, count = [], int(offsets[t]), 0
            for lo, hi, m in cuts:
                count += len(raw[seen:lo].decode())
                size = len(raw[lo:hi].decode())
                ranges.append((count, count + size, m))
                count, seen = count + size, hi
            yield b - a, ranges, b"".join(parts).decode()


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) for every row: ``removed`` lists the removed ranges (start:end,
    code points of the given text), ``text`` is what is left; a null text stays null."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    rows = (keyed.withColumn("id", F.col("doc_id")).join(repeated_places(keyed), ["id", "digest"], "left")
            .select("doc_id", "text", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(removed(batch.column(1), batch.column(2).to_pylist()))
            null = batch.column(1).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in got], pa.int64()),
                 pa.array([sum(m for _, _, m in r) for _, r, _ in got], pa.int64()),
                 pa.array([",".join(f"{a}:{b}" for a, b, _ in r) for _, r, _ in got], pa.string()),
                 pa.array([t if ok else None for (_, _, t), ok in zip(got, null)], pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return rows.mapInArrow(run, "doc_id bigint, n_sentences bigint, n_removed bigint, removed string, text string")
