"""Packing documents into windows of token ids by best-fit decreasing.

Overlong documents are first cut into full windows; each remainder goes to the
open window with the least room that still takes it, which a segment tree
indexed by remaining capacity finds.  Remainders are dealt by hash to shards of
about ``SHARD`` pieces, packed one shard a task: a shard leaves at most a few
windows ajar, so padding stays near that of one global packing while no task
grows with the input.

Defined results: a null or empty text is the end id alone; rows repeated with
one ``doc_id`` are separate documents; an empty table gives an empty plan;
other input columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small_batches
from scriptorium.llm.tokens import encoder, tokenizer_path

WINDOW, END_ID, SHARD = 2048, 1, 2048


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = self.leaves + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room >= need; None if there is none."""
        tree, i = self.tree, self.leaves + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            tree[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, in the order given; ties go by position."""
    tree = CapacityTree(capacity)
    window, offset, made = [0] * len(lengths), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[k]) if lengths[k] < capacity else None
        room, at = found or (capacity, made)
        made += found is None
        window[k], offset[k] = at, capacity - room
        if room > lengths[k]:
            tree.add(room - lengths[k], at)
    return window, offset


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them into pieces of at most ``window`` ids.

    With ``with_ids`` each piece carries its ids as little-endian 16-bit (if
    the vocabulary allows) or 32-bit integers in ``ids``.
    """
    small_batches(docs.sparkSession, "4m")
    path = tokenizer or tokenizer_path()

    def cut_texts(batches):
        own = encoder(path)
        narrow = own.tokenizer.get_vocab_size() <= 65536
        for batch in batches:
            ids, ends = own.encode_texts(batch.column("text"), end_id)
            total = np.diff(ends, prepend=0)
            count = -(-total // window)
            doc = np.repeat(np.arange(len(total)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, total[doc] - start)
            begin = (ends - total)[doc] + start
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                # Pieces follow each other in ``ids``, so one buffer holds them all.
                plain = ids.astype("<u2") if narrow else ids.astype("<u4", copy=False)
                at = np.append(begin, len(ids)) * plain.itemsize
                columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain)]).cast(pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(cut_texts, PIECE + ", ids binary" * with_ids)


def sharded(items: DataFrame, count: int, shard: int = SHARD) -> DataFrame:
    """``items``, ``count`` or so, plus ``__shard``: about ``shard`` pieces each, dealt by hash of id and start."""
    shards = max(1, round(count / shard))
    return items.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The packing plan, a row per piece: the piece, its ``sequence_id`` and its ``offset`` there."""
    items = cut(pieces(docs, tokenizer, window, end_id))
    items = sharded(items, items.count())

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        at, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        base = int(pdf["__shard"].iloc[0]) << 40
        return pdf.drop(columns="__shard").assign(sequence_id=np.array(at, dtype=np.int64) + base, offset=offset)

    return items.groupBy("__shard").applyInPandas(place, PIECE + ", sequence_id long, offset long")
