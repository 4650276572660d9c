"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct k-word shingles (64-bit hashes; the whole
sequence as one shingle if it has fewer words).  The top byte of a hash picks
one of 256 buckets; a bucket's register stores, of its smallest remaining
value, the number of leading zeros and ``MANTISSA`` further bits.  An empty
bucket borrows the register of the first filled bucket in a fixed random
order of its own, so short documents band like long ones.  (Only for banding:
estimates use filled registers alone.)

Bands of ``ROWS`` registers bring candidates together; the share of equal
registers, corrected for the chance collisions of truncated registers, gives
a Jaccard estimate; pairs that can reach the threshold are confirmed on their
full sets.

* Documents with equal sets are one class before banding (exact copies cost
  nothing further).
* Candidates are taken in two passes.  First each band bucket's members
  against its smallest member: as many pairs as members.  Then only buckets
  whose members are still in different components are looked at again: the
  members outside the bucket's largest component are compared with the whole
  of that component, and with one another, in blocks of fixed size.  There
  registers and full sets are compared inside the task, and only links that
  join two components leave it, so the rows made follow the number of
  members, not of pairs.  No pair that shares a bucket and could join two
  components is left out.
* At similarity 0.8 a pair shares no band with probability
  (1 - 0.8**5)**51 = 1.6e-9.

Nulls and empty texts have an empty set and link with nothing.  Rows that
share a doc_id are one document: their links are joined.  Rows with a null
doc_id link with nothing.  Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.shared import bitmap_has, cut, id_bitmap, is_empty
from legflow.operators.graph import components

BUCKETS = 256
MANTISSA = 10
VALUE_BITS = 48
ROWS = 5
BANDS = BUCKETS // ROWS
#: Sets held at once when a group is compared in blocks, and pairs of one document confirmed by one task.
BLOCK = 512
#: Standard deviations that an estimate may fall short before a candidate is dropped unconfirmed.
SLACK = 6.0


# ------------------------------------------------------------------ sketches

def fill_order() -> np.ndarray:
    """For each bucket a fixed random order in which it looks for a filled one."""
    if "order" not in W.CACHE:
        W.CACHE["order"] = np.argsort(W.mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(99))
                                      .reshape(BUCKETS, BUCKETS), axis=1)
    return W.CACHE["order"]


def registers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x BUCKETS) of sorted distinct hash sets; 0 where a bucket is empty."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    cell = text * BUCKETS + (values >> np.uint64(56)).astype(np.int64)
    first = np.empty(len(cell), bool)
    first[:1] = True
    np.not_equal(cell[1:], cell[:-1], out=first[1:])
    cell = cell[first]
    low = (values[first] >> np.uint64(56 - VALUE_BITS)) & np.uint64((1 << VALUE_BITS) - 1)
    part, exponent = np.frexp(low.astype(np.float64))
    zeros = VALUE_BITS - exponent
    bits = np.where(low > 0, ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    out = np.zeros(n * BUCKETS, np.uint16)
    out[cell] = (zeros << MANTISSA) + bits + 1
    return out.reshape(n, BUCKETS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys (texts x BANDS) of the bands, after empty buckets have borrowed a register."""
    n = len(regs)
    source = regs.reshape(-1)
    out = source.copy()
    empty = np.flatnonzero((out == 0) & np.repeat(regs.any(axis=1), BUCKETS))
    order, step = fill_order(), 0
    while len(empty):
        bucket = empty % BUCKETS
        got = source[empty - bucket + order[bucket, step]]
        out[empty] = got
        empty = empty[got == 0]
        step += 1
    wide = out.reshape(n, BUCKETS)[:, :BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
    factors = W.odd_numbers(ROWS, 31)
    return W.mix(W.mix((wide * factors).sum(axis=2, dtype=np.uint64)) + W.odd_numbers(BANDS, 57)[None, :])


def sketch(docs: DataFrame, k: int, with_registers: bool = True) -> DataFrame:
    """(doc_id, n, s1, s2[, regs]): set size, 128-bit digest of the set, registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.pieces(batch.column(1)):
                values, at = W.shingle_sets(W.split_words(data, offsets, W.spaced_words()), k)
                total = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(values, out=total[0, 1:])
                np.cumsum(W.mix(values ^ np.uint64(W.BASE)), out=total[1, 1:])
                s1, s2 = (W.mix(t[at[1:]] - t[at[:-1]]).view(np.int64) for t in total)
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(s1), pa.array(s2)]
                names = ["doc_id", "n", "s1", "s2"]
                if with_registers:
                    cols.append(pa.array([r.tobytes() for r in registers(values, at)], pa.binary()))
                    names.append("regs")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n bigint, s1 bigint, s2 bigint" + ", regs binary" * with_registers)


# ---------------------------------------------------------------- estimation

def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of two disjoint sets of n and m values agree in one bucket.

    Sum over leading-zero counts of the chance that both minima fall into the
    same of the 2**MANTISSA cells of that size, the minima's densities being
    taken as level within one zero count.
    """
    a, b = np.maximum(n / BUCKETS, 1.0)[:, None], np.maximum(m / BUCKETS, 1.0)[:, None]
    top = 2.0 ** -np.arange(0, 33)[None, :]
    both = 1.0
    for x in (a, b):
        both = both * ((1 - top / 2) ** x - (1 - top) ** x)
    return both.sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and how many buckets each rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    c = collision_rate(n, m)
    return (same / np.maximum(used, 1) - c) / (1 - c), used


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair can still have a similarity of ``percent``: by set sizes, and by the estimate with SLACK deviations.

    Buckets sample the union without replacement, which is what makes the
    deviation of small sets small; a register and a half is allowed besides.
    """
    t = percent / 100
    j, used = estimate(a, b, n, m)
    union = np.maximum((n + m) / (1 + t), used)
    spread = SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1) * (1 - used / np.maximum(union, 1))) + 1.5 / np.maximum(used, 1)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (j >= t - spread)


def stacked(column) -> np.ndarray:
    """A binary column of registers as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of representatives whose estimate may reach the threshold."""
    a = reps.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru"))
    b = reps.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v, nu, ru, nv, rv = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "v", "nu", "ru", "nv", "rv"))
                ok = may_reach(stacked(ru), stacked(rv), nu.to_numpy(), nv.to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], ["u", "v"])

    return pairs.join(a, "u").join(b, "v").mapInArrow(run, "u bigint, v bigint")


# -------------------------------------------------------------- confirmation

def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, regs, members): registers and sorted shingle hashes of the documents whose id is in ``ids`` (column id).

    A bitmap of fixed size keeps most other documents out before their text
    is shuffled; the join then is exact.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bitmap_has(wanted.value, batch.column(2).to_numpy())
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            for a, b, data, offsets in W.pieces(batch.column(1)):
                values, at = W.shingle_sets(W.split_words(data, offsets, W.spaced_words()), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([r.tobytes() for r in registers(values, at)], pa.binary()),
                     pa.array([values[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "regs", "members"])

    some = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .filter("doc_id is not null").withColumn("digest", F.xxhash64("doc_id")))
    return (some.mapInArrow(run, "doc_id bigint, regs binary, members binary")
            .join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    low, high = sorted((len(x), len(y)))
    if not low or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (low + high - both)


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold.

    Pairs are grouped by their more frequent end, in groups of about BLOCK
    pairs, so its set is sent once a group and a task holds one set and reads
    the others as a stream.
    """
    pairs = cut(pairs)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("uses"))
    sets = cut(full_sets(docs, ends.select("id"), k).select("doc_id", "members"))
    uses = cut(ends)
    side = (pairs.join(uses.select(F.col("id").alias("u"), F.col("uses").alias("cu")), "u")
            .join(uses.select(F.col("id").alias("v"), F.col("uses").alias("cv")), "v")
            .select(F.when(F.expr("cu >= cv"), F.col("u")).otherwise(F.col("v")).alias("hub"),
                    F.when(F.expr("cu >= cv"), F.col("v")).otherwise(F.col("u")).alias("other"),
                    F.greatest("cu", "cv").alias("uses")))
    side = cut(side.withColumn("part", F.pmod(F.xxhash64("other"), F.ceil(F.col("uses") / BLOCK))))
    hubs = (side.select("hub", "part").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub")
            .select("hub", "part", F.lit(None).cast("bigint").alias("other"), "members"))
    others = (side.select("hub", "part", "other").join(sets.withColumnRenamed("doc_id", "other"), "other")
              .select("hub", "part", "other", "members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            u, v = [], []
            for hub, part, other, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(members, np.uint64)
                if (hub, part) != now:
                    now, own = (hub, part), []
                if other is None:
                    own.append(x)
                    continue
                for y in own:
                    if alike(x, y, percent):
                        u.append(min(hub, other))
                        v.append(max(hub, other))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return (hubs.unionByName(others).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())
            .mapInArrow(run, "u bigint, v bigint").distinct())


# ------------------------------------------------------------------ grouping

def bands(reps: DataFrame) -> DataFrame:
    """(key, rep): one row for each band of each representative (rep, regs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                keys = band_keys(stacked(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)),
                                                  pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "key bigint, rep bigint")


def across(docs: DataFrame, shared: DataFrame, comp: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components whose members share a bucket of ``shared`` (key, rep), confirmed on full sets.

    ``comp``: (node, root) of the components so far; other members are their
    own.  u and v are roots.  A group is either a bucket's largest component
    with all members that share a bucket of it from outside, or a bucket's
    members outside its largest component.
    """
    member = cut(shared.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("key", "rep", F.coalesce("root", "rep").alias("comp")))
    mixed = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    member = cut(member.join(mixed, "key"))
    if is_empty(member):
        return member.select(F.col("rep").alias("u"), F.col("comp").alias("v"))
    size = member.groupBy("key", "comp").agg(F.count("*").alias("size"))
    # the largest component of a bucket; of equal ones the smallest id
    main = cut(size.groupBy("key").agg(F.max(F.struct("size", (-F.col("comp")).alias("c"))).alias("top"))
               .select("key", (-F.col("top.c")).alias("main")))
    outside = cut(member.join(main, "key").filter("comp <> main"))
    near = outside.select(F.lit(0).alias("kind"), F.col("main").alias("id"), "rep", "comp").distinct()
    several = outside.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    apart = outside.join(several, "key").select(F.lit(1).alias("kind"), F.col("key").alias("id"), "rep", "comp")
    probes = cut(near.unionByName(apart))
    wanted = near.select("id").distinct()
    inner = (comp.select(F.col("root").alias("id"), F.col("node").alias("rep")).join(wanted, "id")
             .unionByName(wanted.join(comp.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("rep")))
             .select(F.lit(0).alias("kind"), "id", "rep", F.col("id").alias("comp")))
    held = cut(inner.unionByName(apart))
    sets = cut(full_sets(docs, probes.select(F.col("rep").alias("id")).unionByName(held.select(F.col("rep").alias("id"))).distinct(), k))
    n_held = held.groupBy("kind", "id").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    n_probes = probes.groupBy("kind", "id").agg(F.ceil(F.count("*") / BLOCK).alias("slots"))
    groups = cut(n_held.join(n_probes, ["kind", "id"]))
    cols = ["kind", "id", "slot", "part", "side", "rep", "comp"]
    asked = (probes.join(groups, ["kind", "id"]).withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("slots")))
             .withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("side", F.lit(0)))
    read = (held.join(groups, ["kind", "id"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
            .withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)"))).withColumn("side", F.lit(1)))
    rows = asked.select(cols).unionByName(read.select(cols)).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    names = [*cols, "regs", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, block, parent = None, [], None, {}

        def root(c):
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        for batch in batches:
            u, v = [], []
            for kind, i, slot, part, side, rep, comp, regs, members in zip(*(batch.column(j).to_pylist() for j in range(9))):
                if (kind, i, slot, part) != now:
                    now, own, block, parent = (kind, i, slot, part), [], None, {}
                x = np.frombuffer(members, np.uint64)
                if side == 0:
                    own.append((rep, comp, np.frombuffer(regs, np.uint16), x))
                    continue
                if not own:
                    continue
                if block is None:
                    block = (np.array([r for r, _, _, _ in own]), np.array([c for _, c, _, _ in own]), np.array([g for _, _, g, _ in own]),
                             np.array([len(y) for _, _, _, y in own]))
                reps, comps, theirs, sizes = block
                # in a bucket's rest every pair comes twice
                open_ = np.flatnonzero((comps != comp) & ((reps < rep) if kind == 1 else True)
                                       & (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))))
                if not len(open_):
                    continue
                mine = np.broadcast_to(np.frombuffer(regs, np.uint16), (len(open_), BUCKETS))
                open_ = open_[may_reach(theirs[open_], mine, sizes[open_], np.full(len(open_), len(x)), percent)]
                for j in open_.tolist():
                    a, b = root(own[j][1]), root(comp)
                    if a != b and alike(own[j][3], x, percent):
                        parent[max(a, b)] = min(a, b)
                        u.append(own[j][1])
                        v.append(comp)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    by = ["kind", "id", "slot", "part"]
    return rows.select(names).repartition(*by).sortWithinPartitions(*by, "side").mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of
    their sets; component_id is the smallest doc_id reachable.
    """
    # sizes and digests of all documents are kept; registers only of one document for each set
    narrow = cut(sketch(docs, k, with_registers=False))
    reps = cut(sketch(docs, k).filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n")
               .agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")))
    keyed = bands(reps)
    centres = cut(keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last")
                  .select("key", "centre"))
    shared = cut(keyed.join(centres, "key").select("key", "rep", "centre").distinct())
    stars = cut(shared.filter("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct())
    links = cut(confirmed(docs, promising(stars, reps, percent), k, percent))
    sets = cut(reps.select("s1", "s2", "n", "rep"))
    # a doc_id with several texts joins its texts' classes
    several = (narrow.join(sets, ["s1", "s2", "n"]).groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"))
               .filter("u < v").select("u", "v"))
    first = components(links.unionByName(several))
    more = cut(across(docs, shared.select("key", "rep"), first, k, percent))
    if is_empty(more):
        roots = first
    else:
        top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        joined = first.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # components of one member are not in the first table
        roots = joined.unionByName(top.join(first.select(F.col("node").alias("root")), "root", "left_anti")
                                   .select(F.col("root").alias("node"), F.col("top").alias("root")))
    classes = cut(sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("s1", "s2", "n", F.coalesce("root", "rep").alias("component_id")))
    return (narrow.join(classes, ["s1", "s2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
