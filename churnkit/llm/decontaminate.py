"""Benchmark decontamination by greedy string tiling.

Words of test items and documents are compared after lower-casing A-Z, with
everything but letters, digits and marks as separators; characters of scripts
written without spaces are words of their own.  Windows of ``seed_words``
words that an item and a document share (joined by hash in a table of the
items' windows) are the seeds.  From the seeds, greedy string tiling repeatedly
marks the longest match of words not yet covered on either side; Karp-Rabin
hashes of windows find the matches and the words themselves confirm them.  The
share of an item's words under tiles is its coverage, which does not depend on
the order in which a document has the item's parts.  One tile of
``passage_words`` words is enough whatever its share.  Items of fewer than
``min_words`` words are looked up whole.

The items are the stated query set.  They are handled in blocks of bounded
size (``BLOCK_CHARS``), each sent to the tasks as one table; documents are read
once per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from churnkit.llm.textkit import LOWER, PLACE, keyed_text, ngrams, passage_bounds, powers, slices, utf8, word_hashes

SEED_WORDS = 4
THRESHOLD = 0.5
MIN_WORDS = 8
PASSAGE_WORDS = 50
BLOCK_CHARS = 8 << 20
_FILTER_BITS = 22
KR_BASE = 0xD1342543DE82EF95


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    starts, ends, doc = passage_bounds(buf, offsets)
    return word_hashes(buf, starts, ends), doc, offsets, len(offsets) - 1


@dataclass
class ItemBlock:
    """Words of a block of items and the sorted table of their distinct seed windows, one row per seed and item."""

    ids: list
    words: list[np.ndarray]
    seeds: list[np.ndarray]  # of each item, by place
    seed: np.ndarray
    item: np.ndarray
    filter: np.ndarray
    k: int
    chars: list[int]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length: sorted hashes of whole short items, their places

    @staticmethod
    def build(ids: list, texts: list, k: int, min_words: int) -> ItemBlock:
        h, doc, _, n = words_of(pa.array(texts, pa.string()))
        first = np.searchsorted(doc, np.arange(n + 1))
        grams, at = ngrams(h, doc, k)
        cut = np.searchsorted(at, first)
        words = [h[a:b] for a, b in zip(first, first[1:])]
        seeds = [grams[a:b] for a, b in zip(cut, cut[1:])]
        own = [np.unique(s) if len(w) >= min_words else s[:0] for s, w in zip(seeds, words)]
        seed = np.concatenate([*own, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(n), [len(s) for s in own])
        order = np.argsort(seed, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        short = {}
        for size in sorted({len(w) for w in words if 0 < len(w) < max(min_words, k)}):
            places = np.array([i for i, w in enumerate(words) if len(w) == size])
            some = np.concatenate([words[i] for i in places])
            whole = ngrams(some, np.repeat(np.arange(len(places)), size), min(size, len(PLACE)))[0]
            whole = whole[::size - min(size, len(PLACE)) + 1]
            by = np.argsort(whole, kind="stable")
            short[size] = whole[by], places[by]
        return ItemBlock(ids, words, seeds, seed[order], item[order], seen, k, [len(t or "") for t in texts], short)

    def whole_hits(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Distinct (document, item) of the short items that a document holds as a whole."""
        out = set()
        for size, (whole, places) in self.short.items():
            grams, at = ngrams(h, doc, min(size, len(PLACE)))
            low, high = np.searchsorted(whole, grams, side="left"), np.searchsorted(whole, grams, side="right")
            near = np.flatnonzero(high > low)
            pairs = np.stack([doc[at[near]], low[near]])
            if size <= len(PLACE):  # one place of each; a longer one may differ further on
                near = near[np.unique(pairs, axis=1, return_index=True)[1]]
            for g in near:
                a, row = int(at[g]), int(doc[at[g]])
                for i in places[low[g]:high[g]].tolist():
                    if (a + size <= len(h) and doc[a + size - 1] == row and np.array_equal(h[a:a + size], self.words[i])):
                        out.add((row, i))
        return sorted(out)

    def hits(self, grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, row of the seed table) of the windows that are seeds."""
        near = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.seed, grams[near], side="left")
        found = np.flatnonzero((low < len(self.seed)) & (self.seed[np.minimum(low, len(self.seed) - 1)] == grams[near])
                               if len(self.seed) else np.zeros(len(near), bool))
        pairs = np.unique(np.stack([doc[near[found]], low[found]]), axis=1)
        n = np.searchsorted(self.seed, self.seed[pairs[1]], side="right") - pairs[1]
        row = np.repeat(pairs[1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pairs[0], n), self.item[row], row


class _Side:
    """A word sequence with its marks and Karp-Rabin hashes of its free windows."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.free = words, np.ones(n, bool)
        base = powers(KR_BASE, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * base[:n], dtype=np.uint64)])
        self.inverse = powers(pow(KR_BASE, -1, 2**64), n + 1)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the free windows of ``size`` words, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, (self.sums[at + size] - self.sums[at]) * self.inverse[at]


def tiles(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word sequences ``a`` and ``b``: (place in a, place in b, words) of each tile.

    Longest match first, ties by place in a, then b; every word of either side
    lies in one tile at most, and no tile is shorter than ``k``.  The longest
    length is found by binary search, all tiles of that length are marked in
    one pass, then the next shorter length follows.
    """
    x, y, out = _Side(a), _Side(b), []
    top = min(len(a), len(b))
    while top >= k:
        low, high = k - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(x.windows(middle)[1], y.windows(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < k:
            break
        out += _mark(x, y, low)
        top = low - 1
    return out


def _mark(x: _Side, y: _Side, size: int) -> list[tuple[int, int, int]]:
    (ia, ha), (jb, hb) = x.windows(size), y.windows(size)
    shared = np.isin(ha, hb)
    order = np.argsort(hb, kind="stable")
    hb, jb = hb[order], jb[order]
    begin = np.searchsorted(hb, ha[shared], side="left")
    stop = np.searchsorted(hb, ha[shared], side="right")
    next_of: dict[int, int] = {}
    out = []
    for i, s, e in zip(ia[shared].tolist(), begin.tolist(), stop.tolist()):
        if not x.free[i:i + size].all():
            continue
        at = next_of.get(s, s)
        while at < e and not y.free[jb[at]:jb[at] + size].all():
            at += 1
        next_of[s] = at  # what is marked stays marked
        for c in range(at, e):  # beyond the first only after a hash collision
            j = int(jb[c])
            if y.free[j:j + size].all() and np.array_equal(x.words[i:i + size], y.words[j:j + size]):
                x.free[i:i + size] = y.free[j:j + size] = False
                out.append((i, j, size))
                break
    return out


def batch_matches(block: ItemBlock, column, threshold: float,
                  passage_words: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, covered words, item words, tiles, words of the document) of the documents of a slice that reach the
    threshold or have a tile of ``passage_words``."""
    h, doc, _, n = words_of(column)
    sizes = np.bincount(doc, minlength=n).tolist()
    for row, item in block.whole_hits(h, doc):
        yield row, item, len(block.words[item]), len(block.words[item]), 1, sizes[row]
    grams, at = ngrams(h, doc, block.k)
    row, item, seed = block.hits(grams, doc[at])
    if not len(row):
        return
    first = np.searchsorted(doc, np.arange(n + 1))
    order = np.lexsort((seed, item, row))
    row, item, seed = row[order], item[order], seed[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    for s, e in zip(new, np.r_[new[1:], len(row)]):
        a = block.words[item[s]]
        spots = np.flatnonzero(np.isin(block.seeds[item[s]], block.seed[seed[s:e]]))
        reach = np.zeros(len(a) + 1, np.int64)
        np.add.at(reach, spots, 1)
        np.add.at(reach, spots + block.k, -1)
        if (np.cumsum(reach)[:-1] > 0).sum() < min(threshold * len(a), passage_words):
            continue  # no tiling covers more than all seeds together
        got = tiles(a, h[first[row[s]]:first[row[s] + 1]], block.k)
        covered = sum(t[2] for t in got)
        if covered and (covered >= threshold * len(a) or max(t[2] for t in got) >= passage_words):
            yield int(row[s]), int(item[s]), covered, len(a), len(got), sizes[row[s]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, k: int, min_words: int,
                block_chars: int = BLOCK_CHARS) -> Iterator[ItemBlock]:
    """The items in blocks of at most about ``block_chars`` characters, read one partition at a time."""
    ids, texts, size = [], [], 0
    for r in keyed_text(items, id_col, text_col).toLocalIterator():
        ids.append(r["doc_id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
        if size >= block_chars:
            yield ItemBlock.build(ids, texts, k, min_words)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemBlock.build(ids, texts, k, min_words)


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                  seed_words: int = SEED_WORDS, min_words: int = MIN_WORDS,
                  block_chars: int = BLOCK_CHARS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words, n_tiles, coverage for each document that holds at
    least ``threshold`` of an item's words in tiles of ``seed_words`` words or more, or
    ``passage_words`` of them in one tile.

    Items of fewer than ``min_words`` (or ``seed_words``) words match only as
    a whole, word by word; null texts and texts without a word match nothing
    on either side.  Repeated rows of either table match each on their own.
    """
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema[item_id_col].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, n_covered bigint, n_item_words bigint, " \
             "n_tiles bigint, coverage double"
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, seed_words, min_words, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(block)
        part = docs.mapInArrow(_matcher(shared, threshold, passage_words, to_arrow_type(item_type)), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def _matcher(shared, threshold, passage_words, item_type):
    def run(batches):
        block = shared.value
        for b in batches:
            for s in slices(b):
                got = list(batch_matches(block, s.column("text"), threshold, passage_words))
                if got:
                    row, item, covered, total, n, _ = map(list, zip(*got))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": s.column("doc_id").take(pa.array(row)),
                        "item_id": pa.array([block.ids[i] for i in item], item_type),
                        "n_covered": pa.array(covered, pa.int64()), "n_item_words": pa.array(total, pa.int64()),
                        "n_tiles": pa.array(n, pa.int64()),
                        "coverage": pa.array([c / t for c, t in zip(covered, total)], pa.float64())})
    return run


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", threshold: float = THRESHOLD, seed_words: int = SEED_WORDS,
                      min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS,
                      passage_words: int = PASSAGE_WORDS, drop_words: int = 1, drop_chars: int = 1) -> DataFrame:
    """The rows of ``df`` that match no item as in ``contamination``, all columns as they were.

    Items of fewer than ``drop_words`` words or ``drop_chars`` characters, which stand in many clean texts by chance,
    remove only documents that say nothing else; by default any item removes.
    """
    schema = df.schema

    def decides(block, item, total, size):
        return (total >= drop_words and block.chars[item] >= drop_chars) or size == total

    def keeper(shared):
        def run(batches):
            block = shared.value
            for b in batches:
                for s in slices(b, text_col):
                    keep = np.ones(s.num_rows, bool)
                    keep[[row for row, item, _, total, _, size in batch_matches(block, s.column(text_col), threshold, passage_words)
                          if decides(block, item, total, size)]] = False
                    yield s.filter(pa.array(keep))
        return run

    for block in item_blocks(items, item_id_col, item_text_col, seed_words, min_words, block_chars):
        df = df.mapInArrow(keeper(df.sparkSession.sparkContext.broadcast(block)), schema)
    return df
