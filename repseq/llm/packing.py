"""Bounded-space online packing of token ids into fixed-length sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import rows, table
from repseq.llm.tokens import WordIds, default_path
from repseq.session import cut_lineage, given_back, small_batches

#: Ids of a sequence; the id that ends a document; open windows per partition; a gap worth cutting a piece for.
CAPACITY, END, OPEN, GAP = 4096, 2, 64, 32
_PIECE = "start long, length long, doc_tokens long, part int, seq long, off long, ids binary"


class Windows:
    """A fixed number of open windows; pieces go best-fit, and the fullest window leaves when none fits.

    A piece is ``(tag, start, length)``. A window that leaves with a gap of ``gap`` ids or more is first filled with the
    head of the incoming piece, so windows leave (nearly) full.
    """

    def __init__(self, capacity: int, most: int, gap: int):
        self.capacity, self.most, self.gap = capacity, most, gap
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, tag, start: int, length: int) -> Iterator[list]:
        """Places one piece; yields the windows that leave."""
        while length:
            i = bisect_left(self.open, (length, -1))
            if i < len(self.open):
                room, w = self.open.pop(i)
                self.held[w].append((tag, start, length))
                yield from self._keep(room - length, w)
                return
            if len(self.open) < self.most:
                w, self.next = self.next, self.next + 1
                self.held[w] = [(tag, start, length)]
                yield from self._keep(self.capacity - length, w)
                return
            room, w = self.open.pop(0)
            if room >= self.gap:
                self.held[w].append((tag, start, room))
                start, length = start + room, length - room
            yield self.held.pop(w)

    def _keep(self, room: int, w: int) -> Iterator[list]:
        if room:
            insort(self.open, (room, w))
        else:
            yield self.held.pop(w)

    def rest(self) -> Iterator[list]:
        """What is still open, fullest first."""
        for _, w in self.open:
            yield self.held.pop(w)
        self.open = []


def _place(batches, path: str, kind: pa.DataType, capacity: int, most: int, gap: int, with_ids: bool):
    """Packs one partition. Rows of windows that left have ``seq``; of those left over, ``off`` in their stream and ids."""
    part, vocabulary = TaskContext.get().partitionId(), WordIds(path)
    windows, seq, stream, end = Windows(capacity, most, gap), 0, 0, END.to_bytes(4, "little")
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
        out.clear()
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k", "start", "length", "doc_tokens", "part", "seq", "off", "ids", "crc"])

    def leave(window):
        nonlocal seq
        off = 0
        for (key, n, base, ids), start, length in window:
            piece = ids[4 * (start - base) : 4 * (start - base + length)]
            out.append((key, start, length, n, part, seq, off, piece if with_ids else None, zlib.crc32(piece)))
            off += length
        seq += 1

    for b in batches:
        for key, text in rows(b, "k", "t"):
            ids = vocabulary.encode(text or "") + end
            n = len(ids) // 4
            whole = n - n % capacity
            for start in range(0, whole, capacity):
                leave([((key, n, start, ids[4 * start : 4 * (start + capacity)]), start, capacity)])
            tag = (key, n, whole, ids[4 * whole :])  # windows hold remainders only, never a long document
            for window in windows.add(tag, whole, n - whole):
                leave(window)
            if len(out) >= 4096:
                yield flush()
    for window in windows.rest():
        for (key, n, base, ids), start, length in window:
            piece = ids[4 * (start - base) : 4 * (start - base + length)]
            out.append((key, start, length, n, part, None, stream, piece, zlib.crc32(piece)))
            stream += length
    yield flush()


def _cut(batches, capacity: int, with_ids: bool):
    """Cuts left-over pieces, which have a place in one global stream, at the sequence bounds."""
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for key, start, length, n, part, at, ids in rows(b, "k", "start", "length", "doc_tokens", "part", "at", "ids"):
            done = 0
            while done < length:
                seq, off = divmod(at + done, capacity)
                step = min(length - done, capacity - off)
                piece = ids[4 * done : 4 * (done + step)]
                for c, v in zip(cols, (key, start + done, step, n, part, seq, off, piece if with_ids else None, zlib.crc32(piece)), strict=True):
                    c.append(v)
                done += step
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _out_schema(b.schema.field("k").type), strict=True)], schema=_out_schema(b.schema.field("k").type))


def _out_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("k", kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("off", pa.int64()), ("ids", pa.binary()), ("crc", pa.int64())])


def pack(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, windows: int = OPEN, gap: int = GAP, with_ids: bool = False
) -> DataFrame:
    """Packs the token ids of every row's text, with an end id, into sequences of ``capacity`` ids.

    Returns one row per piece: ``key, start`` (the document's ids before it), ``length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, if asked for, ``ids`` (little-endian unsigned 32-bit numbers). Every id of every document
    is in exactly one piece; offsets are gapless from 0 within a sequence.

    Each partition keeps ``windows`` open windows: a document's full sequences leave at once, its remainder goes to the
    window that it fits best, and when it fits none, the fullest window leaves (filled up with the piece's head if
    ``gap`` ids or more are free). What is open at a partition's end joins one stream over all partitions, whose places
    come from a prefix sum over one row per partition, and the stream is cut every ``capacity`` ids; so only the last
    sequence can be short by more than ``gap``.

    NULL texts are empty (the end id alone). Repeated rows are packed as often as they come; an empty table gives none.
    The packing of a partition is written to the checkpoint folder, so a lost executor cannot change it afterwards.
    """
    path = path or default_path()
    kind = df.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"k {kind}, {_PIECE}, crc long"
    placed = cut_lineage(df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lambda it: given_back(_place(it, path, arrow, capacity, windows, gap, with_ids)), schema))

    left = placed.where("seq IS NULL")
    total = left.groupBy("part").agg(F.sum("length").alias("n"))
    base = total.select("part", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    left = left.join(base, "part").select("k", "start", "length", "doc_tokens", "part", (F.col("base") + F.col("off")).alias("at"), "ids")
    left = left.mapInArrow(lambda it: _cut(it, capacity, with_ids), schema)
    full = placed.where("seq IS NOT NULL").withColumn("seq", F.expr("shiftleft(CAST(part + 1 AS BIGINT), 32) + seq"))
    out = full.unionByName(left)  # left-over sequences count from 0, the others from 2^32
    names = {"k": key, "crc": "ids_crc32", "seq": "sequence_id", "off": "offset"}
    return out.withColumnsRenamed(names).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 4096 ids."""
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the documents that are left."""
    small_batches(spark)
    return pack(docs)
