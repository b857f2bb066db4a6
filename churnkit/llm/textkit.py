"""Arrow and numpy helpers that the text operators share inside tasks.

Everything here works on one slice of an Arrow batch: a few MB of whole texts,
held as one byte buffer with document offsets, so that memory per task is
bounded by the slice size or by the longest single text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 2 << 20
LONG_WORD = 256

# white space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# bytes that separate the looser words used for passage matching: every ASCII byte but letters and digits
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.empty(LONG_WORD + 1, np.uint64)
POWER[0] = 1
for _i in range(1, LONG_WORD + 1):
    POWER[_i] = np.uint64((int(POWER[_i - 1]) * 0x9E3779B97F4A7C15) % 2**64)
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns cannot clash with results."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``size`` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Starts, ends (exclusive) and document number of every word; words end at document ends."""
    return bounds(~separator[buf], offsets)


def bounds(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
    """Starts, ends and document number of the runs of ``inside`` bytes; runs also end at ``cuts``."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~cut[:n]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


# ranges of scripts written without spaces between words
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3040, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F))
SEPARATES, JOINS, ALONE = 0, 1, 2


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """SEPARATES, JOINS or ALONE (a word of its own) of each code point below 0x20000; assigned ones that are no
    letter, digit or mark separate."""
    kinds = np.array([JOINS if (c := unicodedata.category(chr(i)))[0] in "LNM" or c in ("Cn", "Co", "Cs") else SEPARATES
                      for i in range(0x20000)], np.uint8)
    for a, b in UNSPACED:
        part = kinds[a:b + 1]
        part[part == JOINS] = ALONE
    kinds[0x2E80:0x2FE0] = ALONE
    return kinds


def passage_bounds(buf: np.ndarray, offsets: np.ndarray):
    """Like ``word_bounds`` for passage matching: letters and digits of any script make words, those of scripts
    without spaces one each."""
    inside = ~NOT_ALNUM[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return bounds(inside, offsets)
    size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
    code = buf[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | buf[lead[more] + k] & 0x3F
    kind = character_kinds()[np.minimum(code, 0x1FFFF)]
    kind[code >= 0x20000] = np.where(code[code >= 0x20000] < 0x40000, ALONE, JOINS)
    for k in range(4):
        inside[lead[(kind == SEPARATES) & (size > k)] + k] = False
    alone = kind == ALONE
    return bounds(inside, offsets, np.concatenate([lead[alone], lead[alone] + size[alone]]))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; depends on its bytes alone.

    A polynomial over random byte values, taken modulo 2**64 and mixed.  Words
    longer than LONG_WORD bytes, where such polynomials have known structural
    collisions, are hashed with xxh3 instead.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    place = np.arange(n, dtype=np.int64) - first
    np.minimum(place, LONG_WORD, out=place)
    value = BYTE_VALUE[buf] * POWER[place]
    # sums over [start, next start); what lies between a word's end and the next start is taken off
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    h = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i]:ends[i]].tobytes())
    return h


def ngrams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words inside one document, and the windows' first word numbers."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1:])
    g = np.zeros(m, np.uint64)
    for j in range(k):
        g += h[j:j + m] * PLACE[j]
    return mix(g[at] + np.uint64(k)), at


@contextmanager
def arrow_rows(spark, most: int):
    """Plans made inside hand at most ``most`` rows at a time to Python; for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


SLOTS = 4096
SAMPLE_LEVELS = 4
SAMPLE_JOBS = 8


def hash_sample(rows: DataFrame, id_col: str, per_group: int, group_col: str | None = None) -> Column:
    """A condition that holds for at most ``per_group`` rows of each group, chosen by hashed id.

    The hash deals rows into slots, which are taken whole in their order while they fit.  One that does not fit is
    dealt anew by another hash, so that the bound holds at any size; rows of one id stay together, and an id with more
    rows than are left to take is passed over.  The cuts come from counts over all rows, so the choice is the same on
    every run.
    """
    group = rows[group_col] if group_col else F.lit("")
    slots = [F.pmod(F.xxhash64(rows[id_col], *([F.lit(n)] if n else [])), F.lit(SLOTS)).cast("int") for n in range(SAMPLE_LEVELS)]

    def below(path):
        out = F.lit(True)
        for c, v in zip(slots, path):
            out = out & (c == v)
        return out

    def counts(inside):
        """Rows per group, path and slot below the wanted (group, path) pairs; all of one level a job."""
        out: dict = {}
        for level in sorted({len(path) for _, path in inside}):
            wanted = F.lit(False)
            name = F.lit("")
            for g, path in inside:
                if len(path) == level:
                    here = (F.lit(True) if g is None else group == F.lit(g)) & below(path)
                    wanted = wanted | here
                    name = F.when(here, F.lit(",".join(map(str, path)))).otherwise(name)
            got = rows.where(wanted).groupBy(group.alias("g"), name.alias("path"), slots[level].alias("slot")).count().collect()
            for r in got:
                if r["g"] is not None:
                    out.setdefault((r["g"], tuple(map(int, filter(None, r["path"].split(","))))), {})[r["slot"]] = r["count"]
        return out

    taken: dict = {}
    found = counts([(None, ())])
    left = {g: per_group for g, _ in found}
    # per group what is still to be looked through, the next one last: (path, sorted slots with counts)
    todo = {g: [(path, sorted(c.items()))] for (g, path), c in found.items()}
    for _ in range(SAMPLE_JOBS):
        again = []
        for g, stack in todo.items():
            while stack and left[g] > per_group // 10:
                path, some = stack.pop()
                for i, (slot, n) in enumerate(some):
                    if n <= left[g]:
                        left[g] -= n
                        taken.setdefault((g, path), []).append(slot)
                    elif len(path) + 1 < SAMPLE_LEVELS:
                        stack.append((path, some[i + 1:]))
                        again.append((g, (*path, slot)))
                        break
                if again and again[-1][0] == g:
                    break
        if not again:
            break
        for (g, path), c in counts(again).items():
            todo[g].append((path, sorted(c.items())))
    keep = F.lit(False)
    for (g, path), some in sorted(taken.items(), key=repr):
        last = slots[len(path)]
        keep = keep | ((group == F.lit(g)) & below(path) & last.isin(some))
    return keep


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
