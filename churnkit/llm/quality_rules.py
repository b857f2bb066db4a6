"""Quality rules on repetition: rolling n-gram hashes measure the characters inside duplicated n-grams and lines.

For each n-gram length the characters of all words that lie in some n-gram
found twice or more in the text are counted once and set against all
characters in words; repeated lines likewise.  All of a slice's texts go
through numpy together; no text is cut short and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.textkit import PLACE, SPACE, keyed_text, mix, slices, utf8, word_bounds, word_hashes

# The largest shares of characters inside duplicated n-grams of each length and inside repeated lines.
# One repeated sentence in a short text stays below them.
MOST_COVERED = {5: 0.35, 6: 0.33, 7: 0.31, 8: 0.29, 9: 0.27, 10: 0.25}
MOST_IN_LINES = 0.25
MOST_SYMBOLS = 0.10  # symbols per word
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = ord("\n")


def equal_keys(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, the place of the first entry of its document with the same key."""
    order = np.argsort(key, kind="stable")  # stable: documents stay in order within a key
    k, d = key[order], doc[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    first = np.empty(len(key), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else 0
    return first


def covered_words(ident: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that their document has twice or more (first occurrence included)."""
    m = len(ident) - n + 1
    out = np.zeros(len(ident), bool)
    if m <= 0:
        return out
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    rolled = np.zeros(m, np.uint64)
    for j in range(n):
        rolled += ident[j:j + m] * PLACE[j]
    first = equal_keys(mix(rolled[at]), doc[at])
    again = np.flatnonzero(first != np.arange(len(at)))
    # windows meet by hash; the words of each repeat are compared with the first occurrence
    if len(again):
        same = np.ones(len(again), bool)
        for j in range(n):
            same &= ident[at[again] + j] == ident[at[first[again]] + j]
        again = again[same]
    mark = np.zeros(len(ident) + 1, np.int64)
    for hit in (at[again], at[np.unique(first[again])] if len(again) else at[:0]):
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + n, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(column) -> dict[str, np.ndarray]:
    """Counts per text of a slice."""
    buf, offsets = utf8(column)
    n_docs = len(offsets) - 1

    def per_doc(values, doc):
        return np.bincount(doc, weights=values, minlength=n_docs).astype(np.int64)

    starts, ends, doc = word_bounds(buf, offsets, SPACE)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    length = points[ends] - points[starts]
    ident = word_hashes(buf, starts, ends)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    out = {"n_words": per_doc(np.ones(len(doc)), doc), "word_chars": per_doc(length, doc),
           "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    # lines: cut at \n and at document ends; a line without a word does not count
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    cut[1:] |= np.r_[buf == _NEWLINE]
    first = np.flatnonzero(cut[:-1]) if len(buf) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(buf)][:len(first)]
    last = last - ((last > first) & (buf[np.maximum(last - 1, 0)] == _NEWLINE)) if len(first) else last
    line_of = np.searchsorted(first, starts, side="right") - 1
    worded = np.unique(line_of)
    first, last = first[worded], last[worded]
    line_doc = np.searchsorted(offsets, first, side="right") - 1
    line_key = _line_keys(buf, first, last)
    earlier = equal_keys(line_key, line_doc)
    dup = earlier != np.arange(len(worded))
    view = buf.tobytes()
    for i in np.flatnonzero(dup):  # confirmed by the bytes
        j = earlier[i]
        dup[i] = view[first[i]:last[i]] == view[first[j]:last[j]]
    chars = np.bincount(np.searchsorted(worded, line_of), weights=length, minlength=len(worded)) if len(worded) else np.zeros(0)
    out["n_dup_lines"] = per_doc(dup.astype(float), line_doc)
    out["dup_line_chars"] = per_doc(chars * dup, line_doc)

    out["n_repeat_words"] = per_doc(covered_words(ident, doc, 3).astype(float), doc)
    for n in MOST_COVERED:
        out[f"dup_{n}_chars"] = per_doc(length * covered_words(ident, doc, n), doc)
    return out


def _line_keys(buf, first, last) -> np.ndarray:
    import xxhash

    view = memoryview(np.ascontiguousarray(buf))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept).  A text is kept when it passes the base rules and no share is above its limit."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~failed & (m["n_symbols"] <= MOST_SYMBOLS * m["n_words"]) & (m["dup_line_chars"] <= MOST_IN_LINES * m["word_chars"])
    for n, most in MOST_COVERED.items():
        kept &= m[f"dup_{n}_chars"] <= most * m["word_chars"]
    return failed, kept


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
          *(f"dup_{n}_chars" for n in MOST_COVERED)]


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of COUNTS, base_failed and kept for every row.

    Null and empty texts have no words and fail.  Repeated rows and null ids
    are kept as they come.
    """
    docs = keyed_text(df, id_col, text_col)

    def run(batches):
        for b in batches:
            for s in slices(b):
                m = measure(s.column("text"))
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept)],
                    ["doc_id", *COUNTS, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean")
