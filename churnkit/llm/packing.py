"""Best-fit packing of tokenized documents into sequences of a fixed length.

A document's token ids (and the closing id) are cut into pieces only where they
exceed the sequence length.  Pieces are packed by bounded-space online best
fit: a fixed number of bins is open at a time, kept under their free space with
a bitset of the occupied free-space values; a piece goes to the fullest open
bin it fits in, and when a new bin is needed and all are open, the fullest one
is closed.

Pieces, not texts, are shuffled: a piece is a few numbers once it is tokenized.
Each shuffle partition packs its own pieces in a fixed order (a hash of
document and piece), so that a task that runs again gives the same sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from churnkit.llm.textkit import keyed_text, slices

SEQUENCE = 4096
CLOSING_ID = 1
OPEN_BINS = 512
CACHED_WORDS = 400_000
CACHED_LENGTH = 24

# Texts of these characters only are cut at blanks and looked up word by word: the tokenizer's own
# steps (composition, white space, lower case, splitting) treat such words one by one.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_SPECIAL = re.compile(r"<\|")
# How the tokenizer file splits words, for the plain characters above.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+")
# its byte alphabet: visible Latin-1 characters stand for themselves, other bytes for U+0100 onwards
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTE_CHAR = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer file drops white space and splits into words before anything
    else, so the ids of a plain text are the ids of its blank-separated words
    in a row; frequent words are remembered.  Any other text goes through the
    tokenizer as a whole.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.cached_words = cached_words

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case plain word: split as the file says, then the file's own merges."""
        ids = []
        for part in _SPLIT.findall(word):
            if not part.isascii():
                part = "".join(map(_BYTE_CHAR.__getitem__, part.encode()))
            ids += [t.id for t in self.model.tokenize(part)]
        return np.array(ids, "<u4").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [not (_PLAIN.search(t) or _SPECIAL.search(t)) if t else True for t in texts]
        words = [t.lower().split() if t and p else [] for t, p in zip(texts, plain)]
        known = self.known
        new = [*{w for ws in words for w in ws if w not in known}]
        here = {w: self._word(w) for w in new}
        if len(known) < self.cached_words:
            known.update({w: b for w, b in here.items() if len(w) <= CACHED_LENGTH})
        out = []
        for t, p, ws in zip(texts, plain, words):
            if p:
                out.append(b"".join([known[w] if w in known else here[w] for w in ws]))
            else:
                out.append(self._encode([t])[0])
        return out


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, cached_words: int = CACHED_WORDS) -> WordTokenizer:
    if (path, cached_words) not in _tokenizers:
        _tokenizers[path, cached_words] = WordTokenizer(path, cached_words)
    return _tokenizers[path, cached_words]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           sequence: int = SEQUENCE, closing_id: int = CLOSING_ID, keep_ids: bool = False,
           cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids`` where asked for) of every document's pieces.

    Null texts read as empty: one piece of the closing id alone.  Repeated rows
    give their pieces once each.
    """
    docs = keyed_text(df, id_col, text_col)
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        tok = tokenizer(tokenizer_path, cached_words)
        for b in batches:
            for s in slices(b):
                cols = {"row": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
                for row, ids in enumerate(tok.encode(s.column("text").to_pylist())):
                    ids += closing
                    for n, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at:at + 4 * sequence]
                        for c, v in zip(cols, (row, n, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else b"")):
                            cols[c].append(v)
                out = [s.column("doc_id").take(pa.array(cols["row"])), pa.array(cols["piece"], pa.int32()),
                       *(pa.array(cols[c], pa.int64()) for c in ("start", "length", "crc"))]
                if keep_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols["ids"]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(out)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.mapInArrow(run, schema + (", ids array<bigint>" if keep_ids else ""))


class BestFit:
    """Bounded-space online best fit: ``place(length)`` gives (sequence number, offset)."""

    def __init__(self, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.sequence, self.open_bins = sequence, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(sequence + 1)]
        self.bits = 0  # bit f is set while an open bin has exactly f free places
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return number

    def _put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting and length:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.sequence, self.n_bins
            self.n_bins += 1
        self._put(number, free - length)
        return number, self.sequence - free


def pack(lengths: Iterable[int], sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    fit = BestFit(sequence, open_bins)
    return (fit.place(n) for n in lengths)


def pack_pieces(parts: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (column ``length`` from 1 to ``sequence``)."""
    def run(batches):
        fit = BestFit(sequence, open_bins)
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            got = [fit.place(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"])

    # by a hash of all that a piece is: exact copies of a text spread out too
    dealt = parts.withColumn("_dealt", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    dealt = dealt.repartition("_dealt").sortWithinPartitions("_dealt", "doc_id", "piece", "ids_crc32").drop("_dealt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence: int = SEQUENCE, closing_id: int = CLOSING_ID, open_bins: int = OPEN_BINS,
                   keep_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack_pieces(pieces(df, tokenizer_path, id_col, text_col, sequence, closing_id, keep_ids, cached_words),
                       sequence, open_bins)
