"""Operator 8: token-ID output in fixed-length rows, packed best-fit-decreasing over the whole table.

Documents are encoded, and those longer than a row are split into whole rows and a rest, losslessly. Best-fit-decreasing
looks only at lengths, and there are no more lengths than a row has tokens: so the driver gets the number of pieces of each
length, and nothing else, and packs ranges of equal rows at a time. A segment tree over the possible amounts of room finds the
fullest rows that still hold a piece in log(row length) steps. The packing is the one that best-fit-decreasing gives for all
pieces of the table, one by one.

Pieces of one length are numbered in an order of their hashes, by sums over small buckets, and the plan says in which row and at
which place the piece of a number goes. So neither the order nor the partitions of the input matter, and no task holds more
than a bucket or a row at once.

Written as Parquet, one row per packed row: pack_id (from 0), ids (row_tokens little-endian uint16, padded), n_tokens,
cu_seqlens (cumulative segment lengths from 0), resets (positions at which position ids start at 0 again: every
segment's first), and segments: the document's id and its text's xxhash64, where in the document's tokens the segment
begins, and its length.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CODECS, Scratch, shared_path, slices, small
from .pieces import Encoder

BUCKET_PIECES = 500


class Room:
    """Ranges of open rows (first row, number of rows) by free room. Node 1 is the root; a leaf counts its ranges."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def put(self, room: int, rows: tuple[int, int]) -> None:
        if not room or not rows[1]:
            return
        self.ranges[room].append(rows)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """Take out a range of rows with the least room of at least `need`: (room, range)."""
        count, node = self.count, self.base + need
        while not count[node]:
            while node & 1:  # a right child: its subtree and all to the left are done
                node >>= 1
            if not node:
                return None
            node += 1
            if count[node]:
                break
        while node < self.base:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        rows = self.ranges[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, rows


class Deal(NamedTuple):
    """Pieces first to first + pieces - 1 of a length go to the rows from `row` on, per_row to each, from place `at` on."""

    length: int
    first: int
    pieces: int
    row: int
    per_row: int
    at: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Deal]:
    """counts: pieces by length, from 1 to capacity. Longest first, each into the fullest row that holds it.

    A piece that has gone into a row makes it fuller, so the next of the same length follows it there while it fits.
    """
    room, deals, rows = Room(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            found = room.take(length)
            if found is None:  # as many new rows as the rest needs
                left, (row, many) = capacity, (rows, -(-(n - done) // (capacity // length)))
                rows += many
            else:
                left, (row, many) = found
            per_row = left // length
            full = min(many, (n - done) // per_row)
            if full:
                deals.append(Deal(length, done, full * per_row, row, per_row, capacity - left))
                room.put(left - per_row * length, (row, full))
                done += full * per_row
            if full < many and done < n:  # too few for another whole row
                deals.append(Deal(length, done, n - done, row + full, n - done, capacity - left))
                room.put(left - (n - done) * length, (row + full, 1))
                full, done = full + 1, n
            room.put(left, (row + full, many - full))
    return deals


def _pieces(row_tokens: int, names: list[str]):
    def run(batches):
        import pyarrow as pa

        encode = Encoder()
        for b in slices(batches):
            of, begin, data = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                if text:
                    ids = encode(text)
                    for at in range(0, len(ids), 2 * row_tokens):
                        of.append(i), begin.append(at // 2), data.append(ids[at : at + 2 * row_tokens])
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(begin, pa.int64()), pa.array([len(x) // 2 for x in data], pa.int32()), pa.array(data, pa.binary())], names)

    return run


def _matrix(row_tokens: int, pad: int):
    """Rows of pieces, sorted by row and place, as packed rows."""

    def built(t):
        import pyarrow as pa

        row, at, length = (t[c].to_numpy() for c in ("row", "at", "length"))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        n = np.diff(np.append(first, len(row)))
        total = np.add.reduceat(length, first)
        which = np.repeat(np.arange(len(first)), n)
        tokens = t["tokens"].combine_chunks()
        edge = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        data = np.frombuffer(tokens.buffers()[2], np.uint8)[edge[0] : edge[-1]].view("<u2")
        ids = np.full((len(first), row_tokens), pad, "<u2")
        before = np.cumsum(length, dtype=np.int64) - length
        ids.reshape(-1)[np.repeat(which.astype(np.int64) * row_tokens + at - before, length) + np.arange(len(data))] = data
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
        whole = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * 2 * row_tokens).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
        cu = np.insert(at, np.append(first[1:], len(at)), total).astype(np.int32)
        segments = pa.StructArray.from_arrays([t[c].combine_chunks() for c in ("id", "text_hash", "begin", "length")], ["id", "text_hash", "begin", "length"])
        columns = [pa.array(row[first]), whole, pa.array(total.astype(np.int32)), lists(pa.array(cu), n + 1), lists(pa.array(at.astype(np.int32)), n), lists(segments, n)]
        return pa.RecordBatch.from_arrays(columns, ["pack_id", "ids", "n_tokens", "cu_seqlens", "resets", "segments"])

    def run(batches):
        import pyarrow as pa

        held = None
        for b in itertools.chain(slices(batches), [None]):
            if b is None:
                t = held
            else:
                t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not len(t):
                continue
            # the last row may go on in the next batch
            done = len(t) if b is None else int(np.searchsorted(t["row"].to_numpy(), t["row"][-1].as_py()))
            held = t.slice(done)
            if done:
                yield built(t.slice(0, done).combine_chunks())

    return run


SCHEMA = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, segments array<struct<id: {kind}, text_hash: long, begin: long, length: int>>"


def pack(docs: DataFrame, path: str | None = None, row_tokens: int = 2048, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write packed rows to path (a fresh folder in the shared directory if none) and return them as read again.

    Null and empty texts have no tokens and so no segment; every other row of docs is packed, repeated rows
    each time (they are alike, so which of them is where makes no difference). Ids may be of any type that can be ordered.
    n_tokens, not the pad id, tells where a row ends. Further columns are ignored. An empty table writes none.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "packed")
    kind = dict(docs.dtypes)[id_col]
    with Scratch(spark, "packing") as scratch:
        names = ["id", "text_hash", "begin", "length", "tokens"]
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        pieces = scratch.write(texts.mapInArrow(_pieces(row_tokens, names), f"id {kind}, text_hash long, begin long, length int, tokens binary"), "pieces", "zstd")
        counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most row_tokens rows
        plan = spark.createDataFrame(best_fit_decreasing(counts, row_tokens), "of int, first long, pieces long, to long, per_row long, place int")
        dealt = spark.createDataFrame([(n, -(-c // BUCKET_PIECES)) for n, c in counts.items()], "of int, buckets long")

        hashed = pieces.withColumn("h", F.xxhash64("id", "text_hash", "begin")).join(F.broadcast(dealt), F.col("length") == F.col("of")).withColumn("bucket", F.pmod("h", "buckets")).drop("of", "buckets")
        sums = hashed.groupBy("length", "bucket").count()
        earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = scratch.write(sums.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")), "bucket-sums")
        within = Window.partitionBy("length", "bucket").orderBy("h", "id", "text_hash", "begin")
        numbered = hashed.withColumn("nth", F.row_number().over(within)).join(small(sums), ["length", "bucket"])
        numbered = numbered.withColumn("number", F.col("before") + F.col("nth") - 1).drop("h", "bucket", "nth", "before")
        j = F.col("number") - F.col("first")
        placed = numbered.join(small(plan), (F.col("length") == F.col("of")) & (j >= 0) & (j < F.col("pieces")))
        placed = placed.select("id", "text_hash", "begin", "length", "tokens", (F.col("to") + F.floor(j / F.col("per_row"))).alias("row"), (F.col("place") + F.pmod(j, F.col("per_row")) * F.col("length")).alias("at"))
        # written first: then the pieces and the shuffle by length can go before that by row
        placed = scratch.write(placed, "placed", "zstd")
        scratch.drop(pieces, rounds=3)
        placed.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_matrix(row_tokens, pad), SCHEMA.format(kind=kind)).write.options(**CODECS["zstd"]).parquet(path)
    return spark.read.parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """The round trip: one row per segment with its document's id and text hash, its place there, and its token bytes."""
    one = packed.select("pack_id", "ids", F.posexplode("segments").alias("nth", "s"), "cu_seqlens")
    position = F.element_at("cu_seqlens", F.col("nth") + 1).alias("position")
    return one.select("pack_id", "s.*", F.expr("substring(ids, 2 * element_at(cu_seqlens, nth + 1) + 1, 2 * s.length)").alias("tokens"), position)
