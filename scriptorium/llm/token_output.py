"""Binary training output: packed id matrices, cumulative segment lengths, position resets.

Best-fit-decreasing packing with segment-tree capacity search (see
``packing``), here with the ids themselves.  Overlong documents are split
losslessly.  Files are Parquet rows, one block of sequences each, so any store
that Spark writes can hold them: ``ids`` is a row-major ``rows x window``
matrix of little-endian unsigned 16-bit (vocabularies up to 65,536) or 32-bit
integers, ``positions`` its position ids (restarting at 0 with every segment)
as unsigned 16- or 32-bit integers, ``cu_seqlens`` the cumulative segment
lengths of every sequence, and ``segments`` names the documents.

Defined results: null and empty texts are the end id alone; padding cells hold
``pad_id`` with position 0; repeated rows are separate documents; an empty
table writes no block and reads back as an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import scratch_dir, small_batches
from scriptorium.llm.packing import END_ID, SHARD, WINDOW, best_fit_decreasing, pieces, sharded

BLOCK = (
    "block long, first_sequence long, rows int, window int, id_bytes int, position_bytes int, ids binary, positions binary, "
    "cu_seqlens array<array<int>>, segments array<struct<row int, doc_id long, start long, doc_tokens long>>"
)
SEGMENT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, positions_ok boolean"


def packed_blocks(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0, shard: int = SHARD) -> DataFrame:
    """Blocks of packed sequences, one per shard of about ``shard`` pieces."""
    # A guess of the pieces sets the number of shards, so that ids are shuffled without being stored first.
    texts, octets = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    items = sharded(pieces(docs, tokenizer, window, end_id, with_ids=True), texts + (octets or 0) // (4 * window), shard)
    position = np.dtype("<u2" if window <= 65536 else "<u4")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        length = pdf["length"].to_numpy()
        at, offset = best_fit_decreasing(length.tolist(), window)
        kind = np.dtype(f"<u{len(pdf['ids'].iloc[0]) // int(length[0])}")
        rows = max(at) + 1
        ids, positions = np.full((rows, window), pad_id, dtype=kind), np.zeros((rows, window), dtype=position)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        named = []
        for doc_id, start, n, total, data, row, begin in zip(pdf["doc_id"], pdf["start"], length, pdf["doc_tokens"], pdf["ids"], at, offset, strict=True):
            ids[row, begin : begin + n] = np.frombuffer(data, kind)
            positions[row, begin : begin + n] = np.arange(n)
            ends[row].append((begin, begin + int(n)))
            named.append((row, begin, None if pd.isna(doc_id) else int(doc_id), int(start), int(total)))
        cumulative = [[0] + [e for _, e in sorted(x)] for x in ends]
        segments = [{"row": r, "doc_id": d, "start": s, "doc_tokens": t} for r, _, d, s, t in sorted(named, key=lambda x: x[:2])]
        shard_id = int(pdf["__shard"].iloc[0])
        return pd.DataFrame([(shard_id, shard_id << 40, rows, window, kind.itemsize, position.itemsize, ids.tobytes(), positions.tobytes(), cumulative, segments)], columns=[x.split()[0] for x in ("block first_sequence rows window id_bytes position_bytes ids positions cu_seqlens segments").split()])

    return items.groupBy("__shard").applyInPandas(block, BLOCK)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed blocks of ``docs`` under ``path`` (options of :func:`packed_blocks`)."""
    packed_blocks(docs, **options).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Read packed blocks back as one row per segment, checked against their own bytes."""
    small_batches(spark, "4m")

    def segments(batches):
        for pdf in batches:
            out = []
            for b in pdf.itertuples(index=False):
                ids = np.frombuffer(b.ids, f"<u{b.id_bytes}").reshape(b.rows, b.window)
                positions = np.frombuffer(b.positions, f"<u{b.position_bytes}").reshape(b.rows, b.window)
                named = iter(b.segments)
                for row, ends in enumerate(b.cu_seqlens):
                    for begin, end in zip(ends[:-1], ends[1:], strict=True):
                        s = next(named)
                        own = ids[row, begin:end].astype("<u4").tobytes()
                        ok = bool((positions[row, begin:end] == np.arange(end - begin)).all()) and s["row"] == row
                        out.append((s["doc_id"], s["start"], end - begin, zlib.crc32(own), s["doc_tokens"], b.first_sequence + row, begin, ok))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SEGMENT.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return spark.read.parquet(path).mapInPandas(segments, SEGMENT)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the packed blocks to the shared scratch folder and read every segment back."""
    path = scratch_dir(docs.sparkSession)
    write_packed(docs, path, **options)
    return read_packed(docs.sparkSession, path)
