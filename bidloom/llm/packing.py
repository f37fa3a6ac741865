"""Best-fit packing of token sequences by hierarchical residual packing.

Each task packs its own pieces best-fit, longest first, and emits the bins that are nearly full. The underfull bins go on as
items: groups of them are merged up a tree and packed best-fit again, until one group is left, or until groups as large as a
task should hold (``GROUP_ITEMS``) emit less than a thousandth of their bins. Only lengths move, never ids; round 0 needs no
shuffle at all, and later rounds move only what is underfull.

Documents longer than a sequence are cut into full pieces; the last piece is packed like any other. A null text counts as empty
and still has its end id; ids may be null or repeat: every row is packed for itself. Pieces of equal length go in order of the
rows. A text of any length is encoded as a whole. An empty table gives an empty result; only the id and text columns are read, so
other columns may have any names.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_BYTES, map_arrow, scalars, stage_table, table, vocabulary, word_tokenizer

#: Tokens a sequence holds.
CAPACITY = 2048
#: A bin with at most this much room left is emitted at once.
SLACK = 8
#: Items one group of a later round holds at most; with more underfull bins there are more groups.
GROUP_ITEMS = 60_000
#: Groups that meet in one of the next round.
FAN_IN = 8
#: A sequence id holds the round in its bits from 58 on, the task or group from 32 on and a number below; so rounds are at most so many.
LEVELS = 30

_PIECES = "array<struct<doc_id:long,piece:int,start:long,length:long,crc:long,offset:long>>"
_BIN = f"sequence_id long, fill int, pieces {_PIECES}"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still has room; ties by item number."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct free rooms, ascending
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        room -= sizes[i]
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class Pieces:
    """Items of pieces in flat arrays: item i has the pieces from ``first[i]`` up to ``first[i + 1]``."""

    NAMES = ("doc_id", "piece", "start", "length", "crc", "offset")

    def __init__(self, columns: list[np.ndarray], known: np.ndarray, first: np.ndarray, fill: np.ndarray):
        self.columns, self.known, self.first, self.fill = columns, known, first, fill

    @classmethod
    def single(cls, rows: dict[str, array], known: array) -> Pieces:
        """One item a piece."""
        columns = [np.frombuffer(rows[k], np.int64) if len(rows[k]) else np.empty(0, np.int64) for k in cls.NAMES[:5]]
        n = len(columns[0])
        return cls([*columns, np.zeros(n, np.int64)], np.array(known, bool), np.arange(n + 1), columns[3])

    @classmethod
    def of_arrow(cls, fill: pa.Array, pieces: pa.ListArray) -> Pieces:
        flat = pieces.flatten()
        columns = [flat.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(len(cls.NAMES))]
        sizes = np.diff(pieces.offsets.to_numpy())
        return cls(columns, flat.field(0).is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), fill.to_numpy().astype(np.int64))

    def packed(self, capacity: int, first_id: int) -> dict[str, pa.Array]:
        """The bins of a best-fit packing, as columns of ``_BIN``."""
        bins = best_fit(self.fill.tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(self.fill))
        ends = np.cumsum(self.fill[order])
        last = np.cumsum([len(b) for b in bins])  # items up to the end of each bin
        fills = np.diff(ends[last - 1], prepend=0)
        # where an item begins in its bin
        begins = ends - self.fill[order] - np.repeat(ends[last - 1] - fills, np.diff(last, prepend=0))
        sizes = np.diff(self.first)[order]
        at = np.repeat(self.first[order] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        columns = [c[at] for c in self.columns]
        columns[5] = columns[5] + np.repeat(begins, sizes)
        return self.bins(columns, self.known[at], np.concatenate([[0], np.cumsum(sizes)[last - 1]]), fills, first_id)

    @classmethod
    def bins(cls, columns: list[np.ndarray], known: np.ndarray, first: np.ndarray, fills: np.ndarray, first_id: int) -> dict[str, pa.Array]:
        fields = [pa.array(columns[0], pa.int64(), mask=~known), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
        struct = pa.StructArray.from_arrays(fields, list(cls.NAMES))
        pieces = pa.ListArray.from_arrays(pa.array(first, pa.int32()), struct, type=pa.list_(pa.field("element", struct.type)))
        return {"sequence_id": pa.array(first_id + np.arange(len(fills)), pa.int64()), "fill": pa.array(fills, pa.int32()), "pieces": pieces}


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row a piece: where it lies in its document and in which sequence, at what offset."""

    def local(batches):
        from pyspark import TaskContext

        encode, task = word_tokenizer(tokenizer, cache_bytes).encode, TaskContext.get().partitionId()
        tail, at = np.array([end_id], "<u4").tobytes(), task << 32
        fresh = lambda: ({k: array("q") for k in Pieces.NAMES[:5]}, array("b"))
        items, items_known = fresh()
        for batch in batches:
            full, full_known = fresh()
            for doc_id, text in zip(scalars(batch.column(0)), scalars(batch.column(1)), strict=True):
                raw = encode(text or "") + tail
                for k, start in enumerate(range(0, len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    to, known = (full, full_known) if n == capacity else (items, items_known)
                    for name, value in zip(Pieces.NAMES, (doc_id or 0, k, start, n, zlib.crc32(part)), strict=False):
                        to[name].append(value)
                    known.append(doc_id is not None)
            if len(full_known):
                p = Pieces.single(full, full_known)
                yield Pieces.bins(p.columns, p.known, p.first, p.fill, at)
                at += len(full_known)
            if len(items_known) >= GROUP_ITEMS:
                yield Pieces.single(items, items_known).packed(capacity, at)
                at += len(items_known)
                items, items_known = fresh()
        if len(items_known):
            yield Pieces.single(items, items_known).packed(capacity, at)

    picked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bins = stage_table(map_arrow(picked, local, _BIN), "pack-0")
    done, groups, level, n = [], None, 0, None
    while True:
        level += 1
        done.append(bins.where(F.col("fill") >= capacity - slack))
        rest = bins.where(F.col("fill") < capacity - slack)
        n, before = rest.count(), n
        # the tree ends in one group, or where a round of full groups has emitted hardly anything
        if not n or groups == 1 or level > LEVELS or (before is not None and groups == -(-before // GROUP_ITEMS) and n > 0.999 * before):
            done.append(rest)
            break
        groups = max(-(-n // GROUP_ITEMS), -(-(groups or n // 256 + 1) // FAN_IN))
        bins = stage_table(_round(rest, groups, capacity, level), f"pack-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    p = F.col("p")
    return out.select("sequence_id", F.explode("pieces").alias("p")).select(
        p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), p["crc"].alias("ids_crc32"), "sequence_id", p["offset"].alias("offset")
    )


def _round(rest: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Best fit in each of so many groups of underfull bins."""

    def group(key: tuple, items: pa.Table) -> pa.Table:
        rows = items.select(["sequence_id", "fill", "pieces"]).sort_by("sequence_id").combine_chunks()
        pieces = rows["pieces"].combine_chunks()
        found = Pieces.of_arrow(rows["fill"].combine_chunks(), pieces).packed(capacity, (level << 58) | (key[0].as_py() << 32))
        return pa.table(found)

    return rest.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("g").applyInArrow(group, _BIN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
