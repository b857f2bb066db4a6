"""Removal of repeated byte strings with hash-compared suffix sorting.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else in the corpus, the same text included.

Sorting every suffix of a corpus would shuffle it many times over, so suffixes
are first dealt to groups that hold all their possible partners:

1. Each window of ``length`` bytes picks its anchor, the leftmost k-gram with
   the smallest hash.  Equal windows pick equal anchors at equal distances, so
   windows need comparing only under the same anchor hash.  Consecutive windows
   mostly share an anchor; the text they span together is its context.
2. Anchors whose hash occurs once are unique, windows and all.  Contexts that
   occur twice or more are repeated as a whole.
3. For the rest, one member per distinct context, the suffixes that start at
   the anchor and the reversed prefixes that end at it are sorted group by
   group with a mergesort.  Its comparisons find common extensions by binary
   search over prefix polynomial hashes; the bytes of neighbours are compared
   afterwards, and a group whose order a hash collision spoilt is sorted by
   its bytes.  Windows at the same distance are equal where neither order has a
   shorter common extension between them.
4. Groups beyond ``HOT`` distinct contexts would not fit one task: their windows
   are counted one by one under a 128-bit hash, in a distributed aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnkit.llm.textkit import BYTE_VALUE, keyed_text, mix, powers, slices, utf8
from churnkit.session import scratch_path

LENGTH = 200
HOT = 4096
FILTER_BITS = 27
SEGMENT = 1 << 21
BATCH_MEMBERS = 4096

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class PrefixHash:
    """Polynomial hashes (modulo 2**64) of any substring of one buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def of(self, start, length):
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


# --- anchors ---------------------------------------------------------------------------------------

def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block-wise running minima."""
    m = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[width - 1:width - 1 + m])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """For each run of windows with one anchor: document, first and last window start, anchor place and hash."""
    starts, stops = offsets[:-1], offsets[1:] - length + 1
    some = stops > starts
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts[some]] += 1
    edge[stops[some]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = []
    for s in range(0, len(buf), SEGMENT):
        part = buf[s:s + SEGMENT + length - 1]
        if len(part) < length:
            break
        hashes = mix(PrefixHash(part).of(np.arange(len(part) - k + 1), k))
        place = np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_min((hashes & ~np.uint64(0x3FFFFF)) | place, length - k + 1) & np.uint64(0x3FFFFF)).astype(np.int64)
        window = np.flatnonzero(inside[s:s + len(at)])
        if not len(window):
            continue
        at = at[window]
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
        last = np.r_[cut[1:] - 1, len(window) - 1]
        out.append((window[cut] + s, window[last] + s, at[cut] + s, hashes[at[cut]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    first, last, place, h = (np.concatenate(c) for c in zip(*out))
    return np.searchsorted(offsets, first, side="right") - 1, first, last, place, h


def anchor_hashes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """h, n: the anchor hashes of each slice with their counts in it."""
    def run(batches):
        for b in batches:
            for s in slices(b):
                h, n = np.unique(anchors(*utf8(s.column("text")), length, k)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, n bigint")


def repeated_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits, two of them set for every hash that occurs twice or more.

    Its size is fixed.  What it lets through wrongly is dropped by exact counts
    later; the more repeats a corpus has, the less it holds back.
    """
    mask = (1 << FILTER_BITS) - 1
    twice = hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", FILTER_BITS).bitwiseAND(mask)))
    words = (twice.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in (h & np.uint64((1 << FILTER_BITS) - 1), (h >> np.uint64(FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)):
        out &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def anchor_table(docs: DataFrame, length: int, k: int, filter_bits: np.ndarray) -> DataFrame:
    """doc_id, th, place, before (distance of the first window's start), after (of the last's), h, ctx of
    the anchors that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches):
        for b in batches:
            for s in slices(b):
                buf, offsets = utf8(s.column("text"))
                found = anchors(buf, offsets, length, k)
                keep = passes(shared.value, found[4])
                doc, first, last, place, h = (c[keep] for c in found)
                if not len(doc):
                    continue
                view = memoryview(np.ascontiguousarray(buf))
                digest = xxhash.xxh3_64_intdigest
                ctx = np.fromiter((digest(view[a:e]) for a, e in zip(first.tolist(), (last + length).tolist())), np.uint64, len(doc))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    s.column("doc_id").take(rows), s.column("th").take(rows), pa.array(place - offsets[doc]),
                    pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32)),
                    pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))],
                    ["doc_id", "th", "place", "before", "after", "h", "ctx"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th bigint, place bigint, before int, after int, h bigint, ctx bigint")


# --- suffix sorting --------------------------------------------------------------------------------

def extension(hashes: PrefixHash, a, b, most):
    """Length of the longest common extension from ``a`` and ``b``, at most ``most``: binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def precedes(data, hashes, start, size, x, y, or_equal):
    """Whether suffix x sorts before suffix y (or is equal, where ``or_equal``)."""
    most = np.minimum(size[x], size[y])
    n = extension(hashes, start[x], start[y], most)
    inner = n < most
    last = len(data) - 1
    less = data[np.minimum(start[x] + n, last)] < data[np.minimum(start[y] + n, last)]
    return np.where(inner, less, np.where(size[x] == size[y], or_equal, size[x] < size[y]))


def merge_sort(data: np.ndarray, hashes: PrefixHash, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Members (grouped, groups in a row) sorted within their groups.

    Bottom-up mergesort of all groups at once: in each round every member
    finds its rank in the sibling run by binary search.
    """
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    bounds = np.r_[first, n]
    g = np.repeat(np.arange(len(first)), np.diff(bounds))
    begin, end = bounds[g], bounds[g + 1]
    width = 1
    widest = int(np.diff(bounds).max())
    while width < widest:
        at = np.flatnonzero(end - begin > width)
        block = begin[at] + (at - begin[at]) // (2 * width) * 2 * width
        middle = np.minimum(block + width, end[at])
        stop = np.minimum(block + 2 * width, end[at])
        lone = middle >= stop
        at, block, middle, stop = at[~lone], block[~lone], middle[~lone], stop[~lone]
        left = at < middle
        low = np.where(left, middle, block)
        high = np.where(left, stop, middle)
        me = order[at]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            probe = (low[todo] + high[todo]) >> 1
            # a member of the left run goes before its equals on the right, and the other way round
            before = precedes(data, hashes, start, size, order[probe], me[todo], ~left[todo])
            low[todo] = np.where(before, probe + 1, low[todo])
            high[todo] = np.where(before, high[todo], probe)
        rank = low - np.where(left, middle, block)
        fresh = order.copy()
        fresh[np.where(left, at + rank, block + (at - middle) + rank)] = me
        order = fresh
        width *= 2
    return order


def neighbours(data, start, size, order, group, reach) -> tuple[np.ndarray, np.ndarray]:
    """Common bytes of each sorted member with the one before it (0 at the start of a group), compared
    byte by byte, and whether the two are in order."""
    common, right = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    pair = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    span = np.arange(reach)
    for s in range(0, len(pair), 4096):
        p = pair[s:s + 4096]
        x, y = order[p - 1], order[p]
        most = np.minimum(size[x], size[y])
        a = data[np.minimum(start[x][:, None] + span, len(data) - 1)]
        b = data[np.minimum(start[y][:, None] + span, len(data) - 1)]
        apart = (a != b) | (span >= most[:, None])
        n = np.where(apart.any(1), apart.argmax(1), reach)
        common[p] = n
        at = np.minimum(n, reach - 1)
        rows = np.arange(len(p))
        right[p] = np.where(n < most, a[rows, at] < b[rows, at], size[x] <= size[y])
    return common, right


def sorted_groups(data, start, size, group, reach) -> tuple[np.ndarray, np.ndarray]:
    order = merge_sort(data, PrefixHash(data), start, size, group)
    common, right = neighbours(data, start, size, order, group, reach)
    if not right.all():  # a hash collision: these groups are sorted by their bytes
        for g in np.unique(group[order[~right]]):
            at = np.flatnonzero(group[order] == g)
            order[at] = sorted(order[at], key=lambda i: data[start[i]:start[i] + size[i]].tobytes())
        common, _ = neighbours(data, start, size, order, group, reach)
    return order, common


def repeated_windows(texts: list[bytes], before: np.ndarray, after: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For contexts (grouped by anchor): whether the window that starts d bytes before the anchor
    equals another member's, as a members x (largest ``before`` + 1) matrix."""
    n, reach = len(texts), int(before.max()) + 1
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    anchor = np.cumsum(size) - size + before
    order_r, common_r = sorted_groups(data, anchor, size - before, group, length)
    order_l, common_l = sorted_groups(np.ascontiguousarray(data[::-1]), len(data) - anchor, before, group, max(reach, 1))
    d = np.arange(reach)
    new = np.r_[True, group[order_r][1:] != group[order_r][:-1]]
    cls_r = np.empty((n, reach), np.int64)
    cls_r[order_r] = np.cumsum(new[:, None] | (common_r[:, None] < length - d), axis=0)
    new = np.r_[True, group[order_l][1:] != group[order_l][:-1]]
    cls_l = np.empty((n, reach), np.int64)
    cls_l[order_l] = np.cumsum(new[:, None] | (common_l[:, None] < d), axis=0)
    key = cls_r * (n + 1) + cls_l
    valid = (d >= after[:, None]) & (d <= before[:, None])
    key = np.where(valid, key, -1 - np.arange(n)[:, None])
    rank = np.argsort(key, axis=0, kind="stable")
    key = np.take_along_axis(key, rank, axis=0)
    same = key[1:] == key[:-1]
    twice = np.zeros((n, reach), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros((n, reach), bool)
    np.put_along_axis(out, rank, twice, axis=0)
    return out & valid


def _sort_groups(length: int):
    """Over members sorted by anchor hash: the repeated spans of the contexts that occur once."""
    names = ["doc_id", "th", "place", "before", "after", "h", "n", "bytes"]

    def run(batches):
        def done(rows):
            doc, th, place, before, after, h, n, texts = (c for c in rows)
            before, after, place = np.array(before), np.array(after), np.array(place)
            found = repeated_windows(texts, before, after, np.array(h), length)
            found[np.array(n) > 1] = False
            step = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(step == 1)
            _, high = np.nonzero(step == -1)
            if len(row):
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc[i] for i in row], kind), pa.array([th[i] for i in row], pa.int64()),
                    pa.array(place[row] - (high - 1)), pa.array(place[row] - low + length)], ["doc_id", "th", "start", "stop"])

        held, kind = [[] for _ in names], pa.int64()
        for b in batches:
            kind = b.schema.field("doc_id").type
            cols = [b.column(c).to_pylist() for c in names]
            h = np.array(cols[5])
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else []
            for s, e in zip(cuts, cuts[1:]):
                if len(held[0]) >= BATCH_MEMBERS and held[5][-1] != h[s]:
                    yield from done(held)
                    held = [[] for _ in names]
                for x, c in zip(held, cols):
                    x += c[s:e]
        if held[0]:
            yield from done(held)

    return run


def _window_hashes(length: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                place, before, after, n = (b.column(c)[r].as_py() for c in ("place", "before", "after", "n"))
                text = b.column("bytes")[r].as_py()
                d = np.arange(after, before + 1)
                digest = [xxhash.xxh3_128_digest(text[before - x:before - x + length]) for x in d]
                row = pa.array(np.full(len(d), r))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("th").take(row), pa.array(place - d),
                                                  pa.array(place - d + length), pa.array(digest, pa.binary()),
                                                  pa.array(np.full(len(d), n, np.int64))],
                                                 ["doc_id", "th", "start", "stop", "digest", "n"])

    return run


def _contexts(length: int):
    """Cut the wanted contexts out of whole texts."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                text = (b.column("text")[r].as_py() or "").encode()
                wanted = b.column("wanted").slice(r, 1).flatten()
                place, before, after = (wanted.field(c).to_numpy() for c in ("place", "before", "after"))
                row = pa.array(np.full(len(place), r))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(row), b.column("th").take(row)]
                    + [wanted.field(c) for c in ("place", "before", "after", "h", "n", "n_ctx")]
                    + [pa.array([text[p - x:p - y + length] for p, x, y in zip(place, before, after)], pa.binary())],
                    ["doc_id", "th", "place", "before", "after", "h", "n", "n_ctx", "bytes"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, th, start, stop (bytes): spans that together cover every repeated byte; they may overlap.
    ``docs`` has doc_id, text and th, a hash of the text that tells repeated ids apart."""
    spark = docs.sparkSession
    k = max(1, length // 5)
    kind = docs.schema["doc_id"].dataType.simpleString()
    path, kept = scratch_path(spark, "repeats-anchors"), scratch_path(spark, "repeats-kept")
    anchor_table(docs, length, k, repeated_filter(anchor_hashes(docs, length, k))).write.parquet(kept)
    kept = spark.read.parquet(kept)
    # one line may hold a large share of all anchors: counts are combined before each exchange, and in the
    # joins Spark can split the tasks of a hot hash
    contexts = kept.groupBy("h", "ctx").agg(F.count("*").alias("n"))
    groups = contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("n_ctx")).where("total > 1")
    counted = contexts.join(groups.select("h", "n_ctx"), "h")
    kept.join(counted, ["h", "ctx"]).write.parquet(path)
    shared = spark.read.parquet(path)

    whole = shared.where("n > 1").select("doc_id", "th", (F.col("place") - F.col("before")).alias("start"),
                                         (F.col("place") - F.col("after") + length).alias("stop"))
    members = shared.where("n_ctx > 1").dropDuplicates(["h", "ctx"])
    wanted = members.groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "before", "after", "h", "n", "n_ctx")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "th": "t"}).hint("shuffle_hash")
    with_text = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("d")) & (docs.th == F.col("t"))).select("doc_id", "th", "text", "wanted")
    cut_path = scratch_path(spark, "repeats-contexts")
    (with_text.mapInArrow(_contexts(length), f"doc_id {kind}, th bigint, place bigint, before int, after int, h bigint, "
                                             "n bigint, n_ctx bigint, bytes binary").write.parquet(cut_path))
    cut = spark.read.parquet(cut_path)

    spans = f"doc_id {kind}, th bigint, start bigint, stop bigint"
    # repeated rows (same id, same text) cut the same context twice
    usual = cut.where(F.col("n_ctx") <= hot).dropDuplicates(["h", "doc_id", "th", "place"])
    usual = usual.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups(length), spans)
    windows = cut.where(F.col("n_ctx") > hot).dropDuplicates(["h", "doc_id", "th", "place"]).mapInArrow(
        _window_hashes(length), f"{spans}, digest binary, n bigint")
    twice = windows.groupBy("digest").agg(F.sum("n").alias("m")).where("m > 1").select("digest")
    hot_spans = windows.where("n = 1").join(twice, "digest").select("doc_id", "th", "start", "stop")
    return whole.unionAll(usual).unionAll(hot_spans)


def _cut(batches):
    for b in batches:
        size, kept, spans = [], [], []
        for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
            text = (text or "").encode()
            runs = []
            for s, e in sorted((f["start"], f["stop"]) for f in found or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            at, parts = 0, []
            for s, e in runs:
                parts.append(text[at:s])
                at = e
            size.append(len(text))
            kept.append(b"".join(parts) + text[at:])
            spans.append([{"start": s, "stop": e} for s, e in runs])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["doc_id", "n_bytes", "kept", "spans"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining UTF-8 bytes), spans (maximal removed runs) for every row.

    Null and empty texts have no bytes; texts shorter than ``length`` lose none.  A repeated row is
    a copy like any other: both lose what they share.
    """
    docs = keyed_text(df, id_col, text_col)
    docs = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeated_spans(docs, length, hot).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    found = found.withColumnsRenamed({"doc_id": "d", "th": "t"}).hint("shuffle_hash")
    joined = docs.join(found, docs.doc_id.eqNullSafe(F.col("d")) & (docs.th == F.col("t")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "found").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>")
