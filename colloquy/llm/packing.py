"""Sum-of-squares online packing of documents into token windows.

Each document is tokenised, with the ids that the tokenizers library gives, and ended by one
separator id. Full windows are cut off its front; the
rest, shorter than a window, goes into the open window whose fill level makes the sum of squared
counts of open windows per level smallest. The counts are kept in an array over the levels, so
placing costs one look at that array, whatever was packed before.

Packing runs inside each input partition, which keeps whole texts off the shuffle and lets a lost
task be redone alone. A partition ends by pouring its open windows into full ones, cutting freely;
what then remains, under a window per partition, becomes sequences whose lengths are powers of
two. The same happens, but for the last window, whenever `most_open` windows are open, which
bounds memory for lengths that do not fit together.

Defined results: a null or empty text is its separator alone; rows are packed each for itself,
repeated or not; a null id stays null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bpe import encoder
from colloquy.llm.common import text_of
from colloquy.llm.segments import pieces

WINDOW = 1024
SCHEMA = ("start long, length long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, ids binary")


class Packer:
    """Packs (key, start, ids as bytes, document's tokens) into windows, and hands out closed ones."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = 2048):
        self.window, self.most_open, self.next = window, most_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window)]  # per level, the windows there
        self.n_open, self.closed = 0, []

    def close(self, pieces: list) -> None:
        offset, size = 0, sum(len(p[2]) for p in pieces) // 4
        for key, start, ids, total in pieces:
            self.closed.append((key, start, len(ids) // 4, total, self.next, offset, size, ids))
            offset += len(ids) // 4
        self.next += 1

    def add(self, key, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.close([(key, at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            self.place((key, whole // 4, ids[whole:], total))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        before = self.count[: self.window - size + 1]
        after = self.count[size:].copy()
        after[-1] = 0  # a full window is not counted
        change = 2 * (after - before) + 2
        change[-1] -= 1
        change[0] = 2 * after[0] + 1 if size < self.window else 0  # a new window
        usable = before > 0
        usable[0] = True
        level = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
            return
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.pour(last=False)

    def pour(self, last: bool) -> None:
        """Refill the open windows one after the other."""
        rest = [p for level in self.open[::-1] for pieces in level for p in pieces]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in rest) // 4
        sizes = [self.window] * (left // self.window)
        tail = left % self.window
        sizes += [1 << b for b in range(tail.bit_length())[::-1] if tail >> b & 1] if last else [tail] * (tail > 0)
        queue = iter(rest)
        piece = None
        for size in sizes:
            pieces, need = [], size
            while need:
                key, start, ids, total = piece or next(queue)
                pieces.append((key, start, ids[: 4 * need], total))
                took = len(pieces[-1][2]) // 4
                piece = (key, start + took, ids[4 * took :], total) if took < len(ids) // 4 else None
                need -= took
            if last or size == self.window:
                self.close(pieces)
            else:
                self.open[size].append(pieces)
                self.count[size] += 1
                self.n_open += 1


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, separator: int = 0,
         id_col: str = "doc_id", text_col: str = "text", most_open: int = 2048) -> DataFrame:
    """One row per piece: id, SCHEMA. `ids` holds the piece's ids as little-endian unsigned 32-bit."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode_column
        packer = Packer(TaskContext.get().partitionId() << 40, window, most_open)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]

        def out(key_type):
            columns = list(zip(*packer.closed))
            packer.closed = []
            arrays = [pa.array(columns[0], key_type)] + [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            return pa.RecordBatch.from_arrays(arrays, [id_col, *names])

        key_type = None
        for whole in batches:
            key_type = whole.schema.field(0).type
            keys = iter(whole.column(0).to_pylist())
            for texts in pieces(whole.column(1)):
                flat, ends = encode(texts)
                data, ends = flat.tobytes(), (4 * ends).tolist()
                for key, a, b in zip(islice(keys, len(texts)), [0, *ends], ends):
                    packer.add(key, data[a:b] + end)
                    if len(packer.closed) >= 4096:
                        yield out(key_type)
        if key_type is not None:
            packer.pour(last=True)
            if packer.closed:
                yield out(key_type)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")
