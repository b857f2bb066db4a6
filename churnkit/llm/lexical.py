"""Ranked lexical search with a K2-treap over the grid of terms and documents.

The index is a table of blocks, each the grid of some documents (columns, by
ascending id) and their terms (rows, the most frequent ones first).  A block's
grid is a quadtree: a node stores which of its four quarters hold anything and
the largest impact in it, the latter as the difference to its parent's; a
single cell is the impact of one term in one document.

A search goes through the blocks.  In a block the paths of an item's rows
descend together: a range of documents has one quadtree node per term, and the
weighted sum of the nodes' maxima bounds every score in the range.  The ranges
with the highest bounds are halved first; ranges below the tenth best score
that the task has seen so far, in this block or another, are never opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from churnkit.llm.textkit import LOWER, NOT_ALNUM, keyed_text, slices, utf8, word_bounds
from churnkit.session import scratch_path

BLOCK_BYTES = 4 << 20
ITEM_CHARS = 8 << 20
RANGES = 128
TOP = 10
# A row of the index is megabytes long.  Parquet looks at the size of what it holds only after 100 rows and reads the pages
# of a row group whole, so every row is looked at: a group ends with the row that makes it full, a page with its value.
INDEX_FORMAT = {"compression": "zstd", "parquet.block.size": str(BLOCK_BYTES), **{
    f"parquet.{what}.size.row.check.{end}": "1" for what in ("block", "page") for end in ("min", "max")}}

# for the sixteen sets of quarters: how many of them come before a quarter, -1 where it is empty
_SET = np.arange(16)[:, None] >> np.arange(4) & 1
RANK = np.where(_SET, np.cumsum(_SET, axis=1) - 1, -1).astype(np.int64).ravel()
COUNT = _SET.sum(axis=1)


def term_spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Lower-cased (A-Z alone) bytes, starts, ends and document number of all terms, and the number of documents."""
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    return buf, *word_bounds(buf, offsets, NOT_ALNUM), len(offsets) - 1


def terms_of(column) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """Distinct terms, each occurrence's term and document number, and the number of documents."""
    buf, starts, ends, doc, n = term_spans(column)
    inside = ~NOT_ALNUM[buf]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buf[inside].tobytes()))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), doc, n


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at the even places of 64."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(keep)
    return x


@dataclass
class Treap:
    """Level by level from the root: occupied quarters, maxima and first children.  The last entry of each array
    stands for an empty node, number -1."""

    masks: list[np.ndarray]
    maxima: list[np.ndarray]
    first: list[np.ndarray]

    @property
    def height(self) -> int:
        return len(self.masks)

    @staticmethod
    def build(rows: np.ndarray, cols: np.ndarray, impact: np.ndarray, height: int) -> tuple[bytes, bytes]:
        """Masks and maxima differences of a grid of side ``2 ** height`` with these cells, root first."""
        z = _spread(rows) << np.uint64(1) | _spread(cols)
        order = np.argsort(z, kind="stable")
        z, top = z[order], impact[order].astype(np.int64)
        masks, gaps = [], []
        for _ in range(height):
            up = z >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (z & np.uint64(3)).astype(np.uint8), start))
            above = np.maximum.reduceat(top, start)
            gaps.append(np.repeat(above, np.diff(np.append(start, len(z)))) - top)
            z, top = up[start], above
        return np.concatenate(masks[::-1]).tobytes(), np.concatenate([top, *gaps[::-1]]).astype("<u4").tobytes()

    @classmethod
    def load(cls, masks: bytes, gaps: bytes, height: int) -> "Treap":
        m, g = np.frombuffer(masks, np.uint8), np.frombuffer(gaps, "<u4").astype(np.int64)
        out, at, n = cls([], [g[:1]], []), 0, 1
        for _ in range(height):
            mask = m[at:at + n]
            size = COUNT[mask]
            first = np.cumsum(size) - size
            at, n = at + n, int(size.sum())
            out.masks.append(np.append(mask, np.uint8(0)))
            out.first.append(np.append(first, 0))
            out.maxima.append(np.repeat(out.maxima[-1], size) - g[at:at + n])
        out.maxima = [np.append(x, 0) for x in out.maxima]
        return out

    def child(self, level: int, nodes: np.ndarray, quarter) -> np.ndarray:
        rank = RANK[self.masks[level][nodes].astype(np.int64) * 4 + quarter]
        return np.where(rank >= 0, self.first[level][nodes] + rank, -1)

    def rows(self, rows: np.ndarray, columns: int) -> tuple[int, np.ndarray]:
        """The level at which one range spans ``columns``, and each row's node there; the paths share the levels above."""
        level, nodes = 0, np.zeros(len(rows), np.int64)
        while level < self.height and columns <= 1 << self.height - level - 1:
            nodes = self.child(level, nodes, 2 * self.bit(rows, level))
            level += 1
        return level, nodes

    def bit(self, rows: np.ndarray, level: int) -> np.ndarray:
        return rows >> self.height - level - 1 & 1


@dataclass
class Best:
    """The ``k`` best documents of an item so far, by score and ascending id (null last)."""

    k: int
    rows: list[tuple[int, bool, object]] = field(default_factory=list)

    @property
    def least(self) -> int:
        """The score that a further document must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], ids: list) -> None:
        new = [(-s, i is None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.rows = sorted(self.rows + new)[:self.k]


def descend(treap: Treap, level: int, nodes: np.ndarray, rows: np.ndarray, weights: np.ndarray, ids: list,
            best: Best, ranges: int = RANGES) -> None:
    """Put the best columns of a block, from the rows' nodes at ``level`` down, into ``best``.

    ``ranges`` of a level are opened at a time, those with the highest bounds, on the level that holds the highest.
    """
    there = nodes >= 0
    nodes, rows, weights = nodes[there], rows[there], weights[there]
    if not len(rows):
        return
    # per level: bound, number and nodes of the ranges not yet opened
    waiting = {level: (treap.maxima[level][nodes][None] @ weights, np.zeros(1, np.int64), nodes[None])}
    while waiting:
        level = max(waiting, key=lambda lv: (waiting[lv][0].max(), lv))
        bound, at, nodes = waiting.pop(level)
        keep = bound >= best.least
        if not keep.any():
            continue
        bound, at, nodes = bound[keep], at[keep], nodes[keep]
        if level == treap.height:
            first = np.lexsort((at, -bound))[:best.k]  # columns are in the order of the ids
            best.add(bound[first].tolist(), [ids[i] for i in at[first].tolist()])
            continue
        if len(bound) > ranges:
            order = np.argsort(-bound, kind="stable")
            rest = order[ranges:]
            waiting[level] = bound[rest], at[rest], nodes[rest]
            at, nodes = at[order[:ranges]], nodes[order[:ranges]]
        row_bit = 2 * treap.bit(rows, level)
        halves = [treap.child(level, nodes, row_bit + c) for c in (0, 1)]
        nodes, at = np.concatenate(halves), np.concatenate([2 * at, 2 * at + 1])
        bound = treap.maxima[level + 1][nodes] @ weights
        keep = bound >= best.least
        if keep.any():
            new = bound[keep], at[keep], nodes[keep]
            old = waiting.get(level + 1)
            waiting[level + 1] = new if old is None else tuple(map(np.concatenate, zip(old, new)))


# ------------------------------------------------------------------ index

def corpus_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""
    def run(batches):
        for b in batches:
            for s in slices(b):
                _, starts, _, doc, _ = term_spans(s.column("text"))
                yield pa.RecordBatch.from_pydict({"docs": [len(np.unique(doc))], "terms": [len(starts)]})

    got = keyed_text(df, id_col, text_col).select("text").mapInArrow(run, "docs bigint, terms bigint")
    r = got.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return r[0], r[1]


def grid_block(ids, column, n_docs: int, n_terms: int) -> dict | None:
    """One index block of a slice of documents."""
    words, code, doc, n = terms_of(column)
    if not len(code):
        return None
    # columns: documents with a term, by ascending id, null ids last
    length = np.bincount(doc, minlength=n)
    order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
    order = order[length[order] > 0]
    col = np.empty(n, np.int64)
    col[order] = np.arange(len(order))
    m = np.array([10 + 90 * x * n_docs // n_terms for x in length[order].tolist()], np.int64)
    cell, tf = np.unique(col[doc] * len(words) + code, return_counts=True)
    col, code = cell // len(words), cell % len(words)
    found = np.bincount(code, minlength=len(words))
    by_count = np.argsort(-found, kind="stable")
    row = np.empty(len(words), np.int64)
    row[by_count] = np.arange(len(words))
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[col])
    height = max(int(max(len(words), len(order)) - 1).bit_length(), 1)
    masks, maxima = Treap.build(row[code], col, impact, height)
    return {"ids": ids.take(pa.array(order)), "terms": words.take(pa.array(by_count)).cast(pa.string()),
            "counts": found[by_count].astype(np.int32), "height": height, "masks": masks, "maxima": maxima}


@dataclass
class Index:
    """Blocks (ids, terms, counts, height, masks, maxima) and the corpus counts that the impacts rest on."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """The index of all whole texts, written to the shared folder.

    Texts are read twice: for the corpus counts and for the blocks.  Null texts
    and texts without a term have no column.  A task holds one block of about
    ``block_bytes``, or one longer text, at a time.
    """
    n_docs, n_terms = corpus_counts(df, id_col, text_col)
    docs = keyed_text(df, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for s in slices(b, size=block_bytes):
                got = grid_block(s.column("doc_id"), s.column("text"), n_docs, n_terms)
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays([0, len(got["ids"])], got["ids"]),
                         pa.ListArray.from_arrays([0, len(got["terms"])], got["terms"]),
                         pa.ListArray.from_arrays([0, len(got["counts"])], pa.array(got["counts"])),
                         pa.array([got["height"]], pa.int32()), pa.array([got["masks"]], pa.binary()),
                         pa.array([got["maxima"]], pa.binary())], ["ids", "terms", "counts", "height", "masks", "maxima"])

    blocks = docs.mapInArrow(run, f"ids array<{id_type}>, terms array<string>, counts array<int>, height int, "
                                  "masks binary, maxima binary")
    path = scratch_path(df.sparkSession, "lexical-index")
    blocks.write.options(**INDEX_FORMAT).parquet(path)
    return Index(df.sparkSession.read.parquet(path), n_docs, n_terms)


# ------------------------------------------------------------------ search

@dataclass
class Items:
    """A block of items: numbers, ids, and each one's distinct terms as places in ``vocabulary``."""

    numbers: list[int]
    ids: list
    terms: list[np.ndarray]
    vocabulary: pa.Array
    weights: np.ndarray | None = None


def item_blocks(items: DataFrame, id_col: str, text_col: str, item_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``item_chars`` characters, read one partition at a time."""
    def block(number, ids, texts):
        words, code, item, n = terms_of(pa.array(texts, pa.string()))
        cell = np.unique(item * max(len(words), 1) + code)
        cut = np.searchsorted(cell, np.arange(n + 1) * max(len(words), 1))
        return Items(list(range(number - len(ids), number)), ids,
                     [cell[a:b] - i * max(len(words), 1) for i, (a, b) in enumerate(zip(cut, cut[1:]))], words.cast(pa.string()))

    ids, texts, size, number = [], [], 0, 0
    for r in keyed_text(items, id_col, text_col).toLocalIterator():
        ids.append(r["doc_id"])
        texts.append(r["text"])
        size, number = size + len(r["text"] or "") + 1, number + 1
        if size >= item_chars:
            yield block(number, ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield block(number, ids, texts)


def document_counts(index: Index, vocabulary: pa.Array) -> np.ndarray:
    """The number of documents that hold each term of the vocabulary, from the blocks' counts alone."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            at = pc.index_in(b.column("terms").flatten(), shared.value)
            known = at.is_valid()
            np.add.at(total, at.filter(known).to_numpy(), b.column("counts").flatten().filter(known).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counts = index.blocks.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for r in counts.collect():  # at most the vocabulary of one block of items
        out[r["term"]] = r["n"]
    return out


def _searcher(shared, k: int, item_type: pa.DataType):
    def run(batches):
        items = shared.value
        best = [Best(k) for _ in items.ids]
        id_type = None
        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                ids = one.column("ids").flatten().to_pylist()
                treap = Treap.load(one.column("masks")[0].as_buffer(), one.column("maxima")[0].as_buffer(),
                                   one.column("height")[0].as_py())
                place = pc.index_in(items.vocabulary, one.column("terms").flatten())
                row = pc.fill_null(place, -1).to_numpy().astype(np.int64)
                here = np.flatnonzero(row >= 0)
                level, node = treap.rows(row[here], len(ids))
                nodes = np.full(len(row), -1, np.int64)
                nodes[here] = node
                for t, found in zip(items.terms, best):
                    descend(treap, level, nodes[t], row[t], items.weights[t], ids, found)
        out = [(items.numbers[i], items.ids[i], None if null else doc, -s) for i, f in enumerate(best) for s, null, doc in f.rows]
        if out:
            number, item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(item, item_type), pa.array(doc, id_type),
                                              pa.array(score, pa.int64())], ["number", "item_id", "doc_id", "score"])
    return run


def search(index: Index, items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", k: int = TOP,
           item_chars: int = ITEM_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents with a score above 0.

    Equal scores go by ascending doc_id, null ids last.  Repeated item rows
    have results of their own, repeated documents are ranked each.  Items
    without a term, or without one that any document holds, have no rows.
    """
    spark = index.blocks.sparkSession
    id_type = index.blocks.schema["ids"].dataType.elementType.simpleString()
    item_type = items.schema[item_id_col].dataType.simpleString()
    arrow_type = to_arrow_type(items.schema[item_id_col].dataType)
    found = None
    for block in item_blocks(items, item_id_col, item_text_col, item_chars):
        counts = document_counts(index, block.vocabulary)
        block.weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in counts.tolist()], np.int64)
        part = index.blocks.mapInArrow(_searcher(spark.sparkContext.broadcast(block), k, arrow_type),
                                       f"number bigint, item_id {item_type}, doc_id {id_type}, score bigint")
        found = part if found is None else found.unionAll(part)
    schema = f"item_id {item_type}, rank int, doc_id {id_type}, score bigint"
    if found is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def lexical_search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", k: int = TOP) -> DataFrame:
    """``search`` over a new index of ``df``."""
    return search(build_index(df, id_col, text_col), items, item_id_col, item_text_col, k)
