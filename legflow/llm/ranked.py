"""Ranked lexical search: documents reduced to bags over the items' words, equal bags scored once.

One pass over the texts keeps of each document its number of words and its
counts of the words that occur in items (the words' bytes are compared, not
only their hashes).  With the corpus' totals known, a document's score for
any item depends on those counts and its length norm m alone.  Documents with
equal counts and equal m form a class: rows are grouped by a hash of both and
by their whole values.  Of a class the ``top`` smallest doc_ids can be
needed and no more, so each map task passes on at most that many rows of a
class however large it is.  Classes are scored once, all items at a time;
a task keeps the best of each item and the lists meet in a last ranking,
where a class is expanded to its members by ascending doc_id.

Words are runs of digits, letters and bytes above 0x7F, with A-Z lower-cased.
With N documents that have words, L words in all, and df documents that hold
a word, the word's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document
of n words has m = 100 - b + (b n N) div L; an item's score sums
weight * ((10^9 tf) div (1000 tf + 8 m)) over its words, repeats included.

Items are taken in blocks of a stated number of bytes, each a search of its
own over the whole corpus; the usual benchmark is one block.

Nulls: a null text has no words.  A row without doc_id is ranked after all
others of equal score.  Repeated rows are ranked each.  Rows of one item_id
are one item, with the words of all its different texts; a null item_id is
an item.  An item without words, or whose words no document holds, has no
rows; so have an empty corpus and an empty benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.shared import small_batches, written

TOP = 10
#: Weight of the length norm in percent (b = 0.75).
NORM = 75
#: Bytes of item text that tasks are sent at once.
BLOCK_BYTES = 8 << 20
#: Classes scored together in a task, and the most (classes x items) sums held.
CLASSES, SUMS = 1024, 4 << 20


class Vocabulary:
    """The different words of a block of items, sorted by hash, with their bytes."""

    def __init__(self, texts: list[str]):
        hashes, counts, starts, ends, base, chunks, item = [], [], [], [], 0, [], []
        for row, _, data, offsets in W.pieces(pa.array(texts, pa.string())):
            w = W.split_words(data, offsets, W.plain_words())
            hashes.append(w.hash)
            starts.append(w.start + base)
            ends.append(w.end + base)
            item.append(row + np.repeat(np.arange(len(w.at) - 1), np.diff(w.at)))
            chunks.append(W.lowered()[data])
            base += len(data)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        data, hashed = join(chunks, np.uint8), join(hashes, np.uint64)
        start, end, item = join(starts, np.int64), join(ends, np.int64), join(item, np.int64)
        self.hash, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        self.length = (end - start)[first]
        self.at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = data[flat(start[first], self.length)]
        # the words of each item with their repeats, by word
        pair, counts = np.unique(which.astype(np.int64) * max(len(texts), 1) + item, return_counts=True)
        self.word, self.item, self.repeats = pair // max(len(texts), 1), pair % max(len(texts), 1), counts

    def __len__(self) -> int:
        return len(self.hash)

    def found(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, vocabulary number) of the words of a piece that are in the vocabulary, compared byte by byte."""
        if not len(self) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.hash, w.hash), len(self) - 1)
        where = np.flatnonzero((self.hash[number] == w.hash) & (self.length[number] == w.end - w.start))
        number = number[where]
        length = self.length[number]
        same = W.lowered()[w.data[flat(w.start[where], length)]] == self.bytes[flat(self.at[number], length)]
        wrong = np.add.reduceat(~same, np.cumsum(length) - length) > 0 if len(where) else np.zeros(0, bool)
        return where[~wrong], number[~wrong]


def flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of every range, one after the other."""
    if not len(start):
        return np.zeros(0, np.int64)
    out = np.ones(int(length.sum()), np.int64)
    first = np.cumsum(length) - length
    out[0] = start[0]
    out[first[1:]] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(out)


def packed(number: np.ndarray, tf: np.ndarray) -> bytes:
    return np.concatenate([number, tf]).astype("<i4").tobytes()


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bag, "<i4")
    return both[:len(both) // 2], both[len(both) // 2:]


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, bag) of every row that has words: their number, and packed (vocabulary number, count) of those in the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in batches:
            counts, out = [], []
            for _, _, data, offsets in W.pieces(batch.column(1)):
                w = W.split_words(data, offsets, W.plain_words())
                where, number = vocabulary.found(w)
                text = np.searchsorted(w.at, where, "right") - 1
                pair, tf = np.unique(text * size + number, return_counts=True)
                at = np.searchsorted(pair, np.arange(len(w.at)) * size)
                number = pair % size
                counts.append(np.diff(w.at))
                out += [packed(number[a:b], tf[a:b]) for a, b in zip(at[:-1], at[1:])]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, bag binary").filter("n > 0")


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each word of the vocabulary; a task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                total[unpacked(bag)[0]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["word", "df"])

    rows = held.select("bag").mapInArrow(run, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


def classes(held: DataFrame, n_docs: int, n_words: int, top: int) -> DataFrame:
    """(m, bag, members): documents of equal bag and m, with their ``top`` smallest doc_ids (nulls last)."""
    m = F.expr(f"{100 - NORM} + cast(cast(n as decimal(38, 0)) * {NORM} * {n_docs} div {n_words} as bigint)")
    rows = held.filter("octet_length(bag) > 0").withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))
    # the hash leads, so that rows are dealt and sorted by it; equal hashes are told apart by the values themselves
    key = ["h", "m", "bag"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))
    return (rows.select(*key, "doc_id").withColumn("nth", nth).filter(F.col("nth") <= top)
            .groupBy(*key).agg(F.collect_list(F.struct("doc_id")).alias("members")).select("m", "bag", "members"))


class Best:
    """The best (score, doc_id) of each item so far, scores descending, doc_ids ascending, nulls last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def least(self, item: int) -> int:
        """What a score must reach to enter."""
        return int(self.score[item][-1]) if len(self.score[item]) == self.top else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score[item], score), (self.doc[item], doc), (self.null[item], null)))
        order = np.lexsort((doc, null, -score))[:self.top]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]


def scored(rows: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, items: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each item within each task's classes."""
    at = np.searchsorted(vocabulary.word, np.arange(len(vocabulary) + 1))
    holders, gain = vocabulary.item, vocabulary.repeats * weight[vocabulary.word]
    step = max(1, min(CLASSES, SUMS // max(items, 1)))

    def sums(m: list[int], bag: list[bytes]) -> np.ndarray:
        """Scores (classes x items), word by word."""
        parts = [unpacked(b) for b in bag]
        size = np.array([len(p[0]) for p in parts])
        word, tf = np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int64)
        row = np.repeat(np.arange(len(bag)), size)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(m, np.int64), size))
        order = np.argsort(word, kind="stable")
        word, row, impact = word[order], row[order], impact[order]
        edge = np.flatnonzero(np.diff(word, prepend=-1, append=-1)) if len(word) else np.zeros(0, int)
        out = np.zeros((len(bag), items), np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            who = slice(at[word[a]], at[word[a] + 1])
            out[row[a:b, None], holders[None, who]] += impact[a:b, None] * gain[None, who]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                members = part.column(2)
                score = sums(part.column(0).to_pylist(), part.column(1).to_pylist())
                inside, offsets = members.flatten().field(0), members.offsets.to_numpy()
                offsets = offsets - offsets[0]
                doc, null = inside.fill_null(0).to_numpy(), inside.is_null().to_numpy(zero_copy_only=False)
                first = offsets[:-1]
                for i in np.flatnonzero((score >= np.array([best.least(i) for i in range(items)])[None, :]).any(axis=0)):
                    there = np.flatnonzero(score[:, i] >= best.least(i))
                    # classes beyond the top by (score, first member) cannot place a member
                    order = np.lexsort((doc[first[there]], null[first[there]], -score[there, i]))[:top]
                    there = there[order]
                    n = offsets[there + 1] - offsets[there]
                    places = flat(offsets[there].astype(np.int64), n.astype(np.int64))
                    best.add(i, np.repeat(score[there, i], n), doc[places], null[places])
        n = np.array([len(s) for s in best.score], np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(items), n), pa.int64()), pa.array(np.concatenate([*best.doc, np.zeros(0, np.int64)]), pa.int64(),
                                                                        mask=np.concatenate([*best.null, np.zeros(0, bool)])),
            pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)]), pa.int64())], ["item", "doc_id", "score"])

    return rows.select("m", "bag", "members").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search_block(docs: DataFrame, texts: list[str], top: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items whose texts are given, numbered in that order."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(texts)
    nothing = spark.createDataFrame([], "item bigint, rank int, doc_id bigint, score bigint")
    if not len(vocabulary):
        return nothing
    held = written(bags(docs, vocabulary), "bags")
    n_docs, n_words = held.agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return nothing
    df = document_counts(held, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    found = scored(classes(held, n_docs, n_words, top), vocabulary, weight, len(texts), top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    items = written(items.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
                    .select("item_id", F.array_join("texts", "\n").alias("text")), "items")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // block_bytes))
    key = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {key}, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id").collect()
        found = search_block(docs, [r.text for r in mine], top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], f"item bigint, item_id {key}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if blocks == 1 else out.unionByName(written(found, "ranked"))
    return out
