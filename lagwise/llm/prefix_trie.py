"""The trie of conversation prefixes: conversations sorted as arrays of turns in global ranges, their adjacent common prefixes swept with a stack.

A turn becomes a cell of 20 bytes, the MD5 of role and text and its number of words; a conversation is its cells one after another, so that comparing
the bytes compares the arrays turn by turn. Conversations are sorted by (cells, conv_id) in ranges, one for each task: copies of one conversation are
spread over ranges too. A task sweeps its range: the common prefix with the conversation before says which frames of the stack are closed, and a closed
frame is a node with all its sums. Frames that may go on in other ranges, the prefixes of a range's first and last conversation (its spines), are left
open: they leave the task with their own partial sums. One task reads the spines in the order of the ranges (ranges times the turns of two conversations,
however many rows there are) and sweeps them in the same way, closing the nodes that lie across borders. The conv_ids that end at a spine's node go
through its SHA-256 there, in pieces: a digest of one string can only be made in sequence, and needs no memory.

What a task holds: one conversation's cells, the stack, and the closed nodes whose parents are still open.

Turns of equal number are ordered by role, then text. Null roles and texts are empty; rows without conv_id belong to no conversation and are left out;
an empty table gives no rows; repeated rows are turns each; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import shuffle_parts, slices, written

#: Bytes of a turn's cell; ids in one row of a spine's ends; conversations that may share a beginning, and the most turns they share.
CELL, ENDS, FAMILY, SHARED = 20, 20_000, 20, 4


def cell(role: Column, text: Column) -> Column:
    """A turn as 40 hexadecimal digits: MD5 of role and text, then the number of words."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.lower(F.hex(words.cast("long"))), 8, "0"))


def _joined(cells: Column) -> Column:
    return F.unhex(F.array_join(cells, ""))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, cells (an array of hexadecimal cells) in the order of turns."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    cells = rows.select("conv_id", at.alias("at"), cell(F.col("role"), F.col("text")).alias("cell"))
    return cells.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda s: s["cell"]).alias("cells"))


def branched(convs: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conv_id, cells: each conversation c with its first h turns replaced by those of c - c % family; h: crc32 of c in decimal digits, modulo shared."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    first = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_of"), F.slice("cells", 1, shared - 1).alias("_first"))
    own = convs.withColumn("_of", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h)
    rest = F.when(F.size("cells") > F.col("_h"), F.slice("cells", F.col("_h") + 1, F.greatest(F.size("cells") - F.col("_h"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    shares = F.when(F.col("_h") > 0, F.slice(F.coalesce("_first", F.array().cast("array<string>")), 1, F.col("_h"))).otherwise(F.array().cast("array<string>"))
    return own.join(first, "_of", "left").select("conv_id", F.concat(shares, rest).alias("cells"))


class Frame:
    """A node on the stack with the sums of what was closed below it. spine: its place among the rows that leave the task; known when it does."""

    __slots__ = ("turn", "depth", "n", "low", "kids", "leaves", "saved", "ends", "sha", "waiting", "left")

    def __init__(self, turn: bytes, depth: int, left: bool = False):
        self.turn, self.depth, self.left = turn, depth, left
        self.n = self.kids = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends, self.sha, self.waiting = array("q"), None, []

    def member(self, low: int, n: int = 1) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)

    def closed(self) -> tuple:
        """The finished node: conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
        words = int.from_bytes(self.turn[16:], "big")
        sha = self.sha or hashlib.sha256(",".join(map(str, self.ends)).encode())
        return self.low, self.depth, self.n, self.kids, self.leaves or 1, self.saved + (self.n - 1) * words, sha.hexdigest()

    def add(self, child: tuple) -> None:
        low, _, n, _, leaves, saved, _ = child
        self.member(low, n)
        self.kids, self.leaves, self.saved = self.kids + 1, self.leaves + leaves, self.saved + saved


_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"part int, spine int, chunk int, right boolean, turn binary, parent int, parent_conv_id long, ends string, {_NODE}"
_STITCHED = f"part int, spine int, node int, parent int, {_NODE}"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], list(names))


def _common(a: bytes, b: bytes) -> int:
    """Cells that a and b begin with alike."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k : k + CELL] == b[k : k + CELL]:
        k += CELL
    return k // CELL


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conv_id, cells -> closed nodes (spine null; parent: the open parent's spine where parent_conv_id isn't known) and the spines' rows."""
    part, stack, before, spine, out = TaskContext.get().partitionId(), [], b"", [], []
    blank = (None,) * 4

    def pop() -> None:
        frame = stack.pop()
        if frame.left:
            spine.append(frame)
            return
        node = frame.closed()
        out.extend((part, *blank, None, frame.low, None, *x) for x in frame.waiting)
        stack[-1].add(node)
        stack[-1].waiting.append(node)

    for rows in slices(batches, 1000):
        for conv, cells in zip(rows["conv_id"], rows["cells"]):
            first = not stack
            if first:
                stack.append(Frame(b"\0" * CELL, 0, True))
            keep = _common(before, cells)
            while len(stack) > keep + 1:
                pop()
            for k in range(keep, len(cells) // CELL):
                stack.append(Frame(cells[k * CELL : (k + 1) * CELL], k + 1, first))
            stack[-1].member(conv)
            stack[-1].ends.append(conv)
            before = cells
        if len(out) > 5000:
            yield _batch(out, _SWEPT)
            out = []
    right = [f for f in stack if not f.left]
    frames = sorted({id(f): f for f in [*spine, *stack] if f.left}.values(), key=lambda f: f.depth) + right
    for i, f in enumerate(frames):
        texts = [",".join(map(str, f.ends[k : k + ENDS])) for k in range(0, len(f.ends), ENDS)] or [None]
        out.append((part, i, 0, not f.left, f.turn, None, None, texts[0], f.low, f.depth, f.n, f.kids, f.leaves, f.saved, None))
        out.extend((part, i, k, not f.left, f.turn, None, None, t, *[None] * 7) for k, t in enumerate(texts) if k)
        out.extend((part, *blank, i, None, None, *x) for x in f.waiting)
        if len(out) > 5000:
            yield _batch(out, _SWEPT)
            out = []
    yield _batch(out, _SWEPT)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spines in order -> part, spine, node (its number) for each of their frames, and the nodes (part null) with their parents' numbers."""
    stack: list[tuple[Frame, int]] = []
    nodes, out = 0, []

    def pop() -> None:
        frame, number = stack.pop()
        node = frame.closed()
        out.append((None, None, number, stack[-1][1] if stack else None, *node))
        if stack:
            stack[-1][0].add(node)

    for rows in slices(batches, 500):
        for part, spine, chunk, right, turn, ends, low, depth, n, kids, leaves, saved in zip(*(rows[k] for k in ("part", "spine", "chunk", "right", "turn", "ends", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"))):
            if chunk == 0:
                if right or len(stack) <= depth or stack[depth][0].turn != turn:
                    while len(stack) > depth:
                        pop()
                    stack.append((Frame(turn, depth), nodes))
                    nodes += 1
                frame, number = stack[depth]  # later pieces of its ends belong to it too
                if n:
                    frame.member(low, n)
                frame.kids, frame.leaves, frame.saved = frame.kids + kids, frame.leaves + leaves, frame.saved + saved
                out.append((part, spine, number, None, *[None] * 7))
            if ends is not None:
                if frame.sha is None:
                    frame.sha = hashlib.sha256(ends.encode())
                else:
                    frame.sha.update(b"," + ends.encode())
        yield _batch(out, _STITCHED)
        out = []
    while stack:
        pop()
    yield _batch(out, _STITCHED)


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of all prefixes of a table conv_id, cells: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (texts that need not be repeated, in words), ends_sha256 (of the ids that end there)."""
    parts = shuffle_parts(convs.sparkSession)
    ranged = convs.select("conv_id", _joined(F.col("cells")).alias("cells")).repartitionByRange(parts, "cells", "conv_id").sortWithinPartitions("cells", "conv_id")
    swept = written(ranged.mapInArrow(_sweep, _SWEPT))
    spines = swept.where("spine is not null").select("part", "spine", "chunk", "right", "turn", "ends", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    stitched = written(spines.repartition(1).sortWithinPartitions("part", "spine", "chunk").mapInArrow(_stitch, _STITCHED))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    across = stitched.where("part is null")
    low = across.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = across.join(low, "parent", "left").select(*columns)
    # the frames of a range's spines with the least member of the node they are part of
    spine_of = stitched.where("part is not null").select("part", "spine", F.col("node").alias("parent")).join(low, "parent").select("part", F.col("spine").alias("parent"), F.col("parent_conv_id").alias("_low"))
    inside = swept.where("spine is null").join(spine_of, ["part", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_low"))
    return nodes.unionByName(inside.select(*columns))
