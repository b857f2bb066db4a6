"""Vector bin packing of instruction examples under limits on tokens, segments and loss-bearing tokens.

An example is a prompt (which may be missing), a response and a closing id;
the ids from the end of the prompt on bear loss, without a prompt all but the
first.  One sequence is filled at a time from a window of waiting examples: of
those that fit in all three dimensions, the one with the largest dot product
of its demand and the room left, both as shares of the limits, goes in.  When
none fits whole, the one with the largest dot product is cut to fill the rest.
A sequence that ends below the full length, because another limit is met or no
example is left, is cut back to the next power of two, which needs no padding;
what is cut off waits again.

Each partition of the input packs its own examples in their order: nothing is
shuffled, and a task that runs again gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from churnkit.llm.packing import tokenizer
from churnkit.llm.textkit import slices

CLOSING_ID = 2
WINDOW = 1024
WINDOW_BYTES = 16 << 20


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; ``tokens`` is a power of two."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


@dataclass(eq=False)
class Example:
    """Ids from ``start`` on are still to be placed; those from ``prompt`` on bear loss."""

    key: object
    ids: bytes
    prompt: int
    start: int = 0

    @property
    def total(self) -> int:
        return len(self.ids) // 4

    def loss(self, start: int, stop: int) -> int:
        return max(0, stop - max(start, self.prompt))

    def cut(self, tokens: int, loss: int) -> int:
        """The most ids from ``start`` on within ``tokens`` and ``loss``."""
        return min(tokens, self.total - self.start, max(self.prompt - self.start, 0) + loss)


class VectorPacker:
    """``add`` examples while ``room`` holds, ``sequence`` takes the next sequence out of those waiting."""

    def __init__(self, limits: Limits = Limits(), window: int = WINDOW, window_bytes: int = WINDOW_BYTES):
        if min(limits.tokens, limits.segments, limits.loss, window) < 1 or limits.tokens & (limits.tokens - 1):
            raise ValueError("limits must be positive and tokens a power of two")
        self.limits, self.window, self.window_bytes = limits, window, window_bytes
        size = window + limits.segments
        self.waiting: list[Example | None] = [None] * size
        self.free = list(range(size))[::-1]
        self.tokens = np.zeros(size)
        self.loss = np.zeros(size)
        self.here = np.zeros(size, bool)
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.waiting) - len(self.free)

    def room(self) -> bool:
        return len(self) < self.window and self.bytes < self.window_bytes

    def add(self, example: Example) -> None:
        slot = self.free.pop()
        self.waiting[slot] = example
        self.bytes += len(example.ids)
        self._note(slot)

    def _note(self, slot: int) -> None:
        e = self.waiting[slot]
        self.tokens[slot], self.loss[slot] = e.total - e.start, e.loss(e.start, e.total)
        self.here[slot] = True

    def _take(self, slot: int) -> Example:
        example = self.waiting[slot]
        self.waiting[slot] = None
        self.here[slot] = False
        self.bytes -= len(example.ids)
        self.free.append(slot)
        return example

    def _next(self, tokens: int, segments: int, loss: int) -> tuple[int, int]:
        """Slot and number of ids of the next piece for the room left; none if the number is 0."""
        cap = self.limits
        if not (tokens and segments and len(self)):
            return 0, 0
        dot = (self.tokens * (tokens / cap.tokens ** 2) + self.loss * (loss / cap.loss ** 2)
               + segments / cap.segments ** 2)
        fits = self.here & (self.tokens <= tokens) & (self.loss <= loss)
        if fits.any():
            slot = int(np.where(fits, dot, -1.0).argmax())
            return slot, int(self.tokens[slot])
        for slot in np.argsort(np.where(self.here, -dot, 1.0), kind="stable")[:len(self)]:
            n = self.waiting[slot].cut(tokens, loss)
            if n:
                return int(slot), n
        return 0, 0

    def sequence(self) -> list[tuple[Example, int, int]]:
        """Pieces (example, start, stop) of one sequence; their lengths add up to a power of two."""
        cap, pieces, loss = self.limits, [], self.limits.loss
        left = cap.tokens
        while True:
            slot, n = self._next(left, cap.segments - len(pieces), loss)
            if not n:
                break
            e = self.waiting[slot]
            start, stop = e.start, e.start + n
            pieces.append((e, start, stop))
            left -= n
            loss -= e.loss(start, stop)
            e.start = stop
            if stop == e.total:
                self._take(slot)
            else:
                self._note(slot)
        length = cap.tokens - left
        spare = length - (1 << length.bit_length() - 1) if length else 0
        while spare:
            e, start, stop = pieces.pop()
            kept = max(start, stop - spare)
            spare -= stop - kept
            waits = e.start < e.total
            e.start = kept  # an example has one piece in a sequence, so its rest follows
            if kept > start:
                pieces.append((e, start, kept))
            if waits:
                self._note(self.waiting.index(e))
            else:
                self.add(e)
        return pieces


def sequences(examples: Iterator[Example], limits: Limits, window: int) -> Iterator[list[tuple[Example, int, int]]]:
    packer = VectorPacker(limits, window)
    for example in examples:
        packer.add(example)
        while not packer.room():
            yield packer.sequence()
    while len(packer):
        yield packer.sequence()


def pack_examples(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  prompt_col: str | None = None, closing_id: int = CLOSING_ID, limits: Limits = Limits(),
                  window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    Null texts and prompts read as empty: such an example is its closing id
    alone.  Ids and other columns may be null, repeated or clash in name;
    every row is an example of its own.  Long texts are cut where a sequence
    ends.  An empty table gives no rows.
    """
    prompt = df[prompt_col].cast("string") if prompt_col else F.lit(None).cast("string")
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), prompt.alias("prompt"))
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        tok = tokenizer(tokenizer_path)
        id_type = None

        def examples():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("doc_id").type
                for s in slices(b):
                    keys = s.column("doc_id").to_pylist()
                    heads = tok.encode(s.column("prompt").to_pylist()) if prompt_col else [b""] * s.num_rows
                    for key, head, ids in zip(keys, heads, tok.encode(s.column("text").to_pylist())):
                        yield Example(key, head + ids + closing, max(len(head) // 4, 1))

        def batch(rows):
            cols = [pa.array([r[0] for r in rows], id_type)]
            cols += [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, len(names) - keep_ids)]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(r[-1], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(cols, names)

        rows, number = [], TaskContext.get().partitionId() << 40
        for pieces in sequences(examples(), limits, window):
            offset = 0
            for e, start, stop in pieces:
                ids = e.ids[4 * start:4 * stop]
                rows.append((e.key, start, stop - start, zlib.crc32(ids), e.total, number, offset, e.loss(start, stop),
                             *([ids] if keep_ids else [])))
                offset += stop - start
            number += 1
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:])
    if keep_ids:
        names, schema = [*names, "ids"], schema + ", ids array<bigint>"
    return docs.mapInArrow(run, schema)
