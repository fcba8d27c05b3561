"""Operator 10: bounded-space online best-fit packing of token ids into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table
from .tokens import ENCODE_BYTES, encoder, spaced_pieces, summed

#: Bins that a task holds open.
OPEN_BINS = 4096


class OpenBins:
    """Open bins by free space. Bit f of a bitset tells whether a bin with f places free is open."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.bits, self.count, self.made = capacity, limit, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The bin for a piece and the piece's place in it: the fullest open bin with room, or else a new one."""
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_space[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return number


PACKED = "piece int, start long, length long, ids binary, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most capacity tokens: (id, piece, start, length, ids, sequence_id, offset), one row per piece.

    A document is its text's ids, without added special tokens, and end_id. Only documents of more than capacity ids are
    cut. Each task packs its own rows as they come, with at most open_bins bins open, and numbers its bins apart from other
    tasks', so nothing is shuffled and a task that is run again stands for itself. ids are little-endian unsigned 32-bit
    numbers. Placed at offset, the pieces of a sequence have no gaps.

    Null and empty text: end_id alone. Repeated rows and ids, and null ids: each row is packed. Very long texts: cut, every
    id kept. No rows: no pieces. Further columns of docs are left out.
    """
    named = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"), F.spark_partition_id().cast("long").alias("__task"))
    schema = T.StructType([named.schema.fields[0], *T._parse_datatype_string(PACKED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(path, spaced_pieces), OpenBins(capacity, open_bins)
        for batch in batches:
            for part in slices(batch, "__text", ENCODE_BYTES):
                yield placed(part, encode, bins)

    def placed(part: pa.RecordBatch, encode, bins: OpenBins) -> pa.RecordBatch:
        codes, ids, ends, per_text = encode(part.column(1))
        sizes = np.diff(ends)
        # each text's ids, one text after another, with end_id behind each
        n_ids = summed(sizes[codes], per_text) + 1
        doc_at = np.concatenate([[0], np.cumsum(n_ids)])
        each = sizes[codes]
        out = np.full(int(doc_at[-1]), end_id, np.uint32)
        from_at = np.repeat(ends[:-1][codes] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) if len(each) else np.zeros(0, np.int64)
        flat = ids[from_at + np.arange(len(from_at))]
        hole = np.zeros(len(out), bool)
        hole[doc_at[1:] - 1] = True
        out[~hole] = flat
        n_pieces = -(-n_ids // capacity)
        row = np.repeat(np.arange(part.num_rows), n_pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = piece * capacity
        length = np.minimum(capacity, n_ids[row] - start)
        base = int(part.column(2)[0].as_py()) << 33
        where = np.array([bins.place(n) for n in length.tolist()], np.int64).reshape(-1, 2)
        cuts = np.append((doc_at[row] + start), doc_at[-1]) * 4
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out.astype("<u4"))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), packed, pa.array(where[:, 0] + base), pa.array(where[:, 1])],
            [f.name for f in schema.fields],
        )

    return named.mapInArrow(run, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
