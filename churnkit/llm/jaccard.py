"""N-gram Jaccard join with signature trees.

Documents are sets of distinct word n-grams; two link when their Jaccard
similarity reaches a threshold.  Steps:

1. Sets are hashed and equal sets collapse to one class, so copies cost
   nothing further on.
2. Prefix keys: of the ``n`` n-grams of a set, ordered rarest first, any
   ``n - ceil(t n) + 1`` must hold one that a linked set has in its own prefix.
   The order comes from counts over all documents; it decides how full the
   buckets are, never the result.
3. In each bucket (the classes that share a key) a signature tree is built: its
   nodes hold the OR of their members' n-gram bitmaps and the range of set
   sizes.  A dual traversal of the tree with itself drops every pair of nodes
   whose largest possible overlap is below the threshold.
4. What is left is checked on the full sets.

A bucket of many alike classes has no use for all its pairs: the first pass
asks for a spanning star of each group only, the second for the pairs that
still lie in different components.  Buckets beyond ``BLOCK`` members are cut
into blocks: joined by their smallest member in the first pass, by all pairs
of blocks in the second, where whole groups have left them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from churnkit.llm.components import components
from churnkit.llm.manifest import ranked, written
from churnkit.llm.textkit import LOWER, PLACE, arrow_rows, keyed_text, mix, ngrams, slices, utf8, word_bounds, word_hashes
from churnkit.session import reliable, scratch_path

SHINGLE = 4
PERCENT = 85
SMALLEST_BITMAP, LARGEST_BITMAP = 9, 18  # powers of two
LEAF = 16
FANOUT = 4
BLOCK = 8192
FREQUENT = 2_000_000
COUNTED_AT_ONCE = 2_000_000
BROADCAST_IDS = 1_000_000
PAIRS_AT_ONCE = 500  # two full sets a row


def shingle_sets(column, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer than ``k`` words are one n-gram, no words none."""
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    starts, ends, doc = word_bounds(buf, offsets)
    h = word_hashes(buf, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    g, at = ngrams(h, doc, k)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(g[cut[i]:cut[i + 1]]))
        elif b > a:
            out.append(mix((h[a:b] * PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def required(n: int, percent: int) -> int:
    return -(-percent * n // 100)


# --- the order of n-grams ----------------------------------------------------------------------

def _local_counts(k: int) -> Callable:
    def run(batches):
        held, size = [], 0

        def counts():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > 2
            return pa.RecordBatch.from_arrays([pa.array(g[often].view(np.int64)), pa.array(c[often].astype(np.int64))],
                                              ["gram", "n"])

        for b in batches:
            for s in slices(b):
                for g in shingle_sets(s.column("text"), k):
                    held.append(g)
                    size += len(g)
                if size >= COUNTED_AT_ONCE:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    return run


def frequent_grams(docs: DataFrame, k: int = SHINGLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the ``most`` most frequent n-grams at most.  Counts leave out what a
    task met once or twice."""
    counted = reliable(docs.select("text").mapInArrow(_local_counts(k), "gram bigint, n bigint")
                       .groupBy("gram").agg(F.sum("n").alias("n")))
    # the smallest count that leaves at most `most` n-grams, from the number of n-grams of each count
    least, listed = 3, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("grams")).where("n > 2").collect(), reverse=True):
        listed += r["grams"]
        if listed > most:
            least = r["n"] + 1
            break
    got = counted.where(F.col("n") >= least).toArrow()
    gram = got["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], got["n"].to_numpy()[order]


def prefix(grams: np.ndarray, size: int, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``size`` n-grams, rarest first, ties by hash."""
    if len(often) and len(grams):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        known = often[at] == grams
        if known.any():
            late = grams[known][np.lexsort((grams[known], counts[at[known]]))]
            return np.concatenate([grams[~known], late])[:size]
    return grams[:size]


def set_table(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """doc_id, n, digest (128 bits of the whole set), bits (the set's bitmap), keys (the prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        grams, counts = shared.value
        for b in batches:
            for s in slices(b):
                sets = shingle_sets(s.column("text"), k)
                keys = [prefix(g, len(g) - required(len(g), percent) + 1, grams, counts).view(np.int64) if len(g) else
                        np.zeros(0, np.int64) for g in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    s.column("doc_id"), pa.array([len(g) for g in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()),
                    pa.array([signature(g).tobytes() for g in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                    ["doc_id", "n", "digest", "bits", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, bits binary, keys array<bigint>")


# --- signature trees ---------------------------------------------------------------------------

def signature(grams: np.ndarray) -> np.ndarray:
    """Bitmap of a set, about four bits per n-gram; its width is a power of two, so that it folds to any smaller one."""
    width = 1 << max(SMALLEST_BITMAP, min(LARGEST_BITMAP, (4 * len(grams) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(grams >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


class SignatureTree:
    """Members sorted by set size in leaves of LEAF; levels of FANOUT nodes above them.

    A node has the OR of its bitmaps, its smallest and largest set, and the
    most n-grams that a member has beyond its number of bits.
    """

    def __init__(self, size: np.ndarray, bits: np.ndarray, group: np.ndarray, percent: int):
        self.percent = percent
        self.size, self.bits, self.group = size, bits, group
        slack = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.slack = slack
        self.levels = []
        cut, step = np.arange(0, len(size), LEAF), LEAF
        level = (np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut),
                 np.maximum.reduceat(slack, cut))
        self.levels.append((step, *level))
        while len(cut) > 1:
            cut = np.arange(0, len(level[0]), FANOUT)
            step *= FANOUT
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut),
                     np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append((step, *level))

    def can_link(self, overlap, smaller, larger):
        """Whether sets of these sizes with this overlap at most can reach the threshold."""
        return (100 + self.percent) * overlap >= self.percent * (smaller + larger)

    def nodes_can_link(self, depth: int, x: int, y: int) -> bool:
        _, bits, low, high, slack = self.levels[depth]
        shared = int(np.bitwise_count(bits[x] & bits[y]).sum())
        most = min(shared + min(slack[x], slack[y]), high[x], high[y])
        return bool(self.can_link(most, max(low[x], most), max(low[y], most)))

    def _alike(self, depth: int, x: int, y: int) -> bool:
        step, n = self.levels[depth][0], len(self.size)
        g = self.group[x * step]
        return bool((self.group[x * step:min(n, (x + 1) * step)] == g).all()
                    and (self.group[y * step:min(n, (y + 1) * step)] == g).all())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Member numbers (i < j) of the pairs of different groups that the bitmaps cannot rule out, leaf by leaf.
        Groups may be merged between two steps."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        n = len(self.size)
        while todo:
            depth, x, y = todo.pop()
            if self._alike(depth, x, y) or not self.nodes_can_link(depth, x, y):
                continue
            if depth:
                below = len(self.levels[depth - 1][1])
                xs = range(x * FANOUT, min(below, (x + 1) * FANOUT))
                ys = range(y * FANOUT, min(below, (y + 1) * FANOUT))
                nearby = [(depth - 1, a, b) for a in xs for b in ys if a <= b]
                todo += sorted(nearby, key=lambda t: t[1] - t[2])  # near nodes are taken first
                continue
            i = np.arange(x * LEAF, min(n, (x + 1) * LEAF))
            j = np.arange(y * LEAF, min(n, (y + 1) * LEAF))
            shared = np.bitwise_count(self.bits[i][:, None] & self.bits[j][None]).sum(2).astype(np.int64)
            most = np.minimum(shared + np.minimum(self.slack[i][:, None], self.slack[j][None]),
                              np.minimum(self.size[i][:, None], self.size[j][None]))
            ok = self.can_link(most, self.size[i][:, None], self.size[j][None])
            ok &= (i[:, None] < j[None]) & (self.group[i][:, None] != self.group[j][None])
            a, b = np.nonzero(ok)
            if len(a):
                yield i[a], j[b]


def pair_can_link(tree: SignatureTree, bits: list[np.ndarray], i: int, j: int) -> bool:
    """The bound again, on the two bitmaps at the largest width that both have."""
    words = min(len(bits[i]), len(bits[j]))
    if words == tree.bits.shape[1]:
        return True
    x, y = folded(bits[i], words), folded(bits[j], words)
    shared = int(np.bitwise_count(x & y).sum())
    most = shared + min(int(tree.size[i]) - int(np.bitwise_count(x).sum()), int(tree.size[j]) - int(np.bitwise_count(y).sum()))
    return bool(tree.can_link(most, int(tree.size[i]), int(tree.size[j])))


def star_pairs(tree: SignatureTree, ids: np.ndarray, bits: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that would join what the bitmaps cannot tell apart, one less than the members of each group."""
    out = []
    for a, b in tree.pairs():
        for i, j in zip(a, b):
            gi, gj = tree.group[i], tree.group[j]
            if gi != gj and pair_can_link(tree, bits, i, j):
                out.append((int(i), int(j)))
                tree.group[tree.group == max(gi, gj)] = min(gi, gj)
    # through the smallest id of each group, so that other buckets name the same pairs
    if len(out) > 1:
        hub = {}
        for i in np.argsort(ids):
            hub.setdefault(int(tree.group[i]), int(i))
        star = []
        for i, j in out:
            h = hub[int(tree.group[i])]
            far = j if j != h else i
            star.append((h, far) if h != far else (i, j))
        missing = set(range(len(ids))) - {x for p in star for x in p}
        star += [(hub[int(tree.group[x])], x) for x in missing if hub[int(tree.group[x])] != x]
        return star
    return out


def _bucket_joins(percent: int, all_pairs: bool) -> Callable:
    """Over rows sorted by bucket and block: the pairs of ids that a bucket asks to check."""
    def join(size, raw, group, ids, block):
        order = np.lexsort((ids, size))
        size, ids, group, block = size[order], ids[order], group[order], block[order]
        bitmaps = [np.frombuffer(raw[i], np.uint64) for i in order]
        # no link crosses a gap in the sizes
        cuts = np.flatnonzero(np.r_[True, percent * size[1:] > 100 * size[:-1], True])
        for s, e in zip(cuts, cuts[1:]):
            if e - s < 2 or (all_pairs and (group[s:e] == group[s]).all()):
                continue
            own = bitmaps[s:e]
            words = min(map(len, own))
            same = np.stack([folded(b, words) for b in own])
            name, part = ids[s:e], block[s:e]
            if all_pairs:
                tree = SignatureTree(size[s:e], same, group[s:e].copy(), percent)
                two = len(np.unique(block)) > 1
                for a, b in tree.pairs():
                    for i, j in zip(a.tolist(), b.tolist()):
                        if (not two or part[i] != part[j]) and pair_can_link(tree, own, i, j):
                            yield name[i], name[j]
            else:
                tree = SignatureTree(size[s:e], same, np.arange(e - s), percent)
                for i, j in star_pairs(tree, name, own):
                    yield name[i], name[j]

    def run(batches):
        held, key = None, None

        def done(rows):
            bucket, size, bits, group, ids, block = rows
            got = [(min(a, b), max(a, b)) for a, b in join(np.array(size), bits, np.array(group), np.array(ids), np.array(block))]
            if got:
                a, b = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                  pa.array([bucket[0]] * len(a), pa.int64())], ["a", "b", "bucket"])

        for batch in batches:
            cols = [batch.column(c) for c in ("bucket", "n", "bits", "grp", "v", "block")]
            bucket = cols[0].to_numpy()
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for s, e in zip(cuts, cuts[1:]):
                part = [c.slice(s, e - s).to_pylist() for c in cols]
                if key is not None and bucket[s] == key:
                    for h, p in zip(held, part):
                        h += p
                    continue
                if held and len(held[0]) > 1:
                    yield from done(held)
                held, key = part, bucket[s]
        if held and len(held[0]) > 1:
            yield from done(held)

    return run


# --- checking pairs on the full sets -------------------------------------------------------------

def _linked(percent: int) -> Callable:
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("v").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        _linked(percent), "a bigint, b bigint")


def _hashed(k: int) -> Callable:
    def run(batches):
        for b in batches:
            for s in slices(b):
                yield pa.RecordBatch.from_arrays([
                    s.column("doc_id"), pa.array([g.tobytes() for g in shingle_sets(s.column("text"), k)], pa.binary())], ["v", "grams"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(v, grams) of the wanted ids, as a written table.  Up to BROADCAST_IDS ids, counted first, go to
    the texts; more are joined by a shuffle of both."""
    spark = docs.sparkSession
    ids, out = scratch_path(spark, "jaccard-wanted"), scratch_path(spark, "jaccard-full")
    wanted.write.parquet(ids)
    wanted = spark.read.parquet(ids)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    (docs.join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text").dropDuplicates()
     .mapInArrow(_hashed(k), "v bigint, grams binary").write.parquet(out))
    return spark.read.parquet(out)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


# --- the join ------------------------------------------------------------------------------------

def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; component_id is the smallest doc_id that
    links of Jaccard similarity of at least ``percent`` / 100 reach.

    Ids of another type than an integer are numbered in their order first.  Texts without a word (null and empty ones too) have an
    empty set and link with nothing.  Rows of one id count as one document: a
    repeated row changes nothing, and different texts under one id share its
    component.  Rows with a null id link with nothing and have a null
    component.
    """
    spark = df.sparkSession
    docs = keyed_text(df, id_col, text_col)
    if docs.schema["doc_id"].dataType not in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()):
        return _numbered(docs, shingle, percent, block)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    often = frequent_grams(docs, shingle)
    path = scratch_path(spark, "jaccard-sets")
    set_table(docs, often, shingle, percent).write.parquet(path)
    table = spark.read.parquet(path)
    linkable = table.where("n > 0 and doc_id is not null")

    classes = reliable(linkable.groupBy("digest").agg(F.min("doc_id").alias("v")))
    # one row of each class stands for it: the smallest id's
    chosen = classes.withColumnRenamed("digest", "of")
    kept = linkable.join(chosen, (F.col("doc_id") == F.col("v")) & (F.col("digest") == F.col("of")))
    signed = reliable(kept.select("v", "digest", "n", "bits").dropDuplicates(["v", "digest"]).select("v", "n", "bits"))
    # both uses below share this one exchange: the filter that a join would add to its side alone is written here
    keyed = kept.select("v", "n", F.explode("keys").alias("key")).where("key is not null").repartition("key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("v").alias("low"), F.max("v").alias("high"),
                                      F.bit_xor(F.xxhash64("v")).alias("print"),
                                      F.sum(F.xxhash64("v").bitwiseAND(0xFFFFFFFF)).alias("print2"),
                                      F.max("n").alias("largest")).where("low < high and largest > 0")  # n: the same columns twice
    # keys with the same members are one bucket
    buckets = shared.groupBy("members", "low", "high", "print", "print2").agg(F.min("key").alias("key"))
    members = keyed.join(buckets.select("key", "members", "low"), "key")
    # a set links only with sets of nearly its size: without one beside it in the order of sizes it leaves the bucket
    by_size = Window.partitionBy("key").orderBy("n", "v")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.lead("n").over(by_size) * percent <= F.col("n") * 100)
    members = reliable(members.withColumn("near", near).where("near").select("key", "v", "members", "low").dropDuplicates(["key", "v"]))

    # first pass: a spanning star of each bucket; blocks of a large bucket share its smallest member
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = members.withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.when(F.col("v") == F.col("low"), F.sequence(F.lit(0), F.col("blocks") - 1))
                             .otherwise(F.array(F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))))
    dealt = dealt.withColumn("block", F.explode("block"))
    asked = reliable(_searched(dealt, signed, percent, None))
    pairs = asked.select("a", "b").distinct()
    sets = full_sets(docs, ends(pairs), shingle)
    with arrow_rows(spark, PAIRS_AT_ONCE):
        edges = reliable(verified(pairs, sets, percent))

    # second pass: pairs of different components
    found = components(edges)
    labelled = members.join(found, F.col("v") == F.col("node"), "left").withColumn(
        "grp", F.coalesce("component", "v")).select("key", "v", "grp", "members")
    spread = labelled.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 < g1").select("key")
    rest = labelled.join(spread, "key").withColumn("blocks", blocks)
    # a bucket in one block that had no pair to check in the first pass has none now
    again = asked.select(F.col("bucket").alias("again")).distinct()
    whole = rest.where("blocks = 1").join(again, _bucket(F.col("key"), F.lit(0)) == F.col("again"), "left_semi")
    rest = whole.unionAll(rest.where("blocks > 1"))
    own = rest.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    paired = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    pairs = reliable(_searched(paired, signed, percent, "grp").select("a", "b").distinct())
    # sets that only pairs across the blocks of a large bucket ask for are still to be fetched
    missing = ends(pairs).join(sets.select("v").distinct(), F.col("id") == F.col("v"), "left_anti")
    sets = sets.unionAll(full_sets(docs, missing, shingle))
    with arrow_rows(spark, PAIRS_AT_ONCE):
        links = reliable(edges.unionAll(verified(pairs, sets, percent)))
    found = components(links)

    labels = classes.join(found, F.col("v") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "v").alias("label"))
    out = table.select("doc_id", "n", "digest").join(labels, "digest", "left")
    by_id = out.where("doc_id is not null and n > 0").select("doc_id", "n", "label")
    single = out.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("label"))
    return by_id.unionAll(single).select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def _numbered(docs: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """The join over ids of any type: numbers that keep their order stand for them."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().withColumn("tree", F.lit(""))
    numbers = written(ranked(ids, ["doc_id"]).select(F.col("doc_id").alias("name"), "at"), "ids")
    rows = docs.join(numbers, docs["doc_id"] == numbers["name"], "left").select(F.col("at").alias("doc_id"), "text")
    found = jaccard_components(rows, shingle=shingle, percent=percent, block=block)
    top = numbers.withColumnsRenamed({"name": "top", "at": "top_at"})
    return (found.join(numbers, found["doc_id"] == numbers["at"], "left").join(top, F.col("component_id") == F.col("top_at"), "left")
            .select(F.col("name").alias("doc_id"), "n_shingles", F.col("top").alias("component_id")))


def _bucket(key, block) -> Column:
    return F.xxhash64(key, block)


def _searched(rows: DataFrame, signed: DataFrame, percent: int, group: str | None) -> DataFrame:
    """Candidate pairs of the trees of all buckets of ``rows`` (key, block, v and, in the second pass, the group)."""
    rows = rows.select(_bucket("key", "block").alias("bucket"), "v",
                       (F.col(group) if group else F.col("v")).alias("grp"),
                       (F.col("own") if group else F.lit(0)).alias("block"))
    rows = rows.join(signed, "v")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_bucket_joins(percent, group is not None), "a bigint, b bigint, bucket bigint")
