"""Counts over all documents in tables whose size doesn't grow with the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back
from .words import ID_BITS, chunks

#: Units of the fixed-point counts: sums of whole numbers don't depend on their order.
UNIT = 1024


class Idf:
    """Inverse document frequencies, ln(1 + 1 / share of documents), from two rows of hashed counters.

    A counter's expected noise, the mean of its row, is taken off; of a shingle's
    two counters the lower one holds. Shares below 2**-rare_bits can't be told
    apart and count as that, at any corpus size, so weights run from 0.7 (in all
    documents) to 10.4 (in almost none).
    """

    def __init__(self, bits: int, rare_bits: int, counts: np.ndarray, units: int):
        rows = counts.astype(np.float64).reshape(2, -1)
        self.bits = bits
        least = max(2.0**-rare_bits, min(1.0, UNIT / max(units, 1)))
        share = np.clip((rows - rows.mean(axis=1, keepdims=True)) / max(units, 1), least, 1.0)
        self.weight = np.log1p(1.0 / share).astype(np.float32)

    @staticmethod
    def counters(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << bits) - 1)
        return (ids & low).astype(np.int64), ((ids >> np.uint64(ID_BITS - bits)) & low).astype(np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.counters(ids, self.bits)
        return np.maximum(self.weight[0][a], self.weight[1][b])


def summed(docs: DataFrame, text: str, size: int, count: Callable[[list[str], np.ndarray], int]) -> tuple[np.ndarray, int]:
    """(a table of ``size`` whole numbers, a number) that ``count`` adds up over chunks of all texts.

    Each task adds up its own table and hands it on in compressed slices, which are
    added up by slice: what moves is a table for each task, whatever its rows.
    """
    slices = 16
    width = size // slices

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, any_row = np.zeros(size, np.int64), 0, False
        for batch in batches:
            for texts in chunks([t or "" for t in batch.column(0).to_pylist()]):
                n += count(texts, table)
                any_row = True
        if any_row:
            parts = [zlib.compress(table[k * width : (k + 1) * width].tobytes(), 1) for k in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(slices), -1], pa.int32()), pa.array([*parts, b""], pa.binary()), pa.array([0] * slices + [n], pa.int64())], names=["slice", "counts", "n"])
        del table
        give_back()

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        n = 0
        for f in frames:
            for k, part, m in zip(f["slice"], f["counts"], f["n"]):
                n += m
                if k >= 0:
                    more = np.frombuffer(zlib.decompress(part), np.int64)
                    total[k] = total[k] + more if k in total else more
        yield pd.DataFrame({"slice": [*total, -1], "counts": [*(zlib.compress(t.tobytes(), 1) for t in total.values()), b""], "n": [0] * len(total) + [n]})

    schema = "slice int, counts binary, n long"
    merged = docs.select(docs[text].cast("string")).mapInArrow(work, schema).repartition(slices, "slice").mapInPandas(add, schema)
    counts, n = np.zeros(size, np.int64), 0
    for r in merged.collect():  # one row for each slice
        n += r["n"]
        if r["slice"] >= 0:
            counts[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return counts, n
