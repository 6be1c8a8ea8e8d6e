"""Packing documents into token windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import slices
from tensorloom.llm.tokens import default_path, piece_tokenizer

WINDOW = 4096
#: Ids waiting in open windows of a task, after which these are closed as at the end of the input.
OPEN_IDS = 4 << 20
#: Pieces, and ids in them, that a task puts out at a time.
OUT_PIECES = 4096
OUT_IDS = 1 << 18

Piece = tuple[int, int, int]  # document, start in it, length


class SumOfSquares:
    """Open windows by level; a document goes to the level at which the sum of squared counts grows least.

    `count[h]` is how many open windows are filled to h. Putting s ids into a window of level h takes 2 count[h] - 1 off the
    sum of squares (nothing where h is 0: a new window) and adds 2 count[h + s] + 1 (nothing where that fills the window);
    ties go to the fullest window.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.ids = 0

    def place(self, doc: int, start: int, size: int) -> list[Piece] | None:
        """Puts a piece into a window; gives the window back if that fills it."""
        top = self.window - size
        grows = 2 * self.count[size : self.window + 1] + 1  # by the level after, for each level before from 0 to top
        grows[-1] = 0
        grows[1:] += 1 - 2 * self.count[1 : top + 1]
        grows[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(grows[::-1]))
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        pieces.append((doc, start, size))
        self.ids += size
        if level + size == self.window:
            self.ids -= self.window
            return pieces
        self.count[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The open windows: the fullest are filled up with documents cut from the emptiest, so one at most stays partial."""
        left = [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]
        self.__init__(self.window)
        low, high = 0, len(left) - 1
        while low < high:
            room = self.window - sum(p[2] for p in left[low])
            while room and low < high:
                doc, start, size = left[high].pop()
                cut = min(room, size)
                left[low].append((doc, start + size - cut, cut))
                if cut < size:
                    left[high].append((doc, start, size - cut))
                room -= cut
                high -= not left[high]
            if room == 0:
                yield left[low]
                low += 1
        if low == high:
            yield left[low]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, ids: bool = True) -> DataFrame:
    """All documents in windows of at most `window` ids: one row a piece.

    Each task packs the rows of its partition as they come: whole windows are cut off a document longer than a window,
    the rest is placed by the sum-of-squares rule. When the partition ends (or OPEN_IDS wait), the open windows are
    merged by cutting, so that a task leaves one partial window at most. There is no shuffle, and a hot source or group
    of copies changes nothing. sequence_id is the task's number and the window's number in it. Null texts are empty (the
    end id alone), repeated rows and ids are packed each, an empty table gives no rows; further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base = piece_tokenizer(tokenizer), TaskContext.get().partitionId() << 32
        bins, held, names, number, pending = SumOfSquares(window), {}, {}, 0, 0
        rows: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal number, pending
            at = 0
            for key, start, size in pieces:
                part = held[key][0][start : start + size]
                rows.append((names[key], start, size, zlib.crc32(part.tobytes()), held[key][1], base + number, at, part))
                at += size
                held[key][2] -= size
                if not held[key][2]:
                    del held[key], names[key]
            number += 1
            pending += at

        def out() -> pa.RecordBatch:
            nonlocal pending
            cols = list(zip(*rows, strict=True))
            rows.clear()
            pending = 0
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.list_(pa.int64()))] * ids
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids)

        key = 0
        for batch in slices(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), tok.encode_all(batch.column("text").fill_null("").to_pylist()), strict=True):
                doc = np.append(found, np.uint32(end_id)).astype("<u4")
                key += 1
                held[key], names[key] = [doc, len(doc), len(doc)], doc_id
                whole = len(doc) // window * window
                for start in range(0, whole, window):
                    emit([(key, start, window)])
                    if pending >= OUT_IDS:
                        yield out()
                if whole < len(doc) and (full := bins.place(key, whole, len(doc) - whole)):
                    emit(full)
                if bins.ids > OPEN_IDS:
                    for pieces in bins.close():
                        emit(pieces)
                        if pending >= OUT_IDS:
                            yield out()
                if pending >= OUT_IDS or len(rows) >= OUT_PIECES:
                    yield out()
        tok.forget()
        for pieces in bins.close():
            emit(pieces)
            if pending >= OUT_IDS:
                yield out()
        if rows:
            yield out()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"), ids=False)


ORACLE = None
