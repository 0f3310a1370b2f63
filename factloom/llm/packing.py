"""Packing token sequences into fixed windows: bounded-space best fit."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, stored

WINDOW = 1024
#: The string that the tokenizer file holds as a special token (fixed value).
SPECIAL = "<|endoftext|>"
#: Long runs of what the tokenizer's pattern takes as white space (fixed values: Unicode's White_Space).
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]{200,}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long, left boolean"
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())]


@functools.cache
def tokenizer(json_path: str, ranks_path: str | None):
    """text -> ids of the tokenizer at ``json_path``.

    ``ranks_path`` names the same vocabulary as byte-pair ranks; it gives the same ids several times
    faster and is used for every text without the special token's own string. Its pattern backtracks
    through white space, so long runs of it are cut out first: but for its last character, a run
    before a word is one piece of the pattern, and so is a whole run at the end of the text.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)

    def slow(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if not ranks_path:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> list[int]:
        out, at = [], 0
        for m in BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += quick.encode_ordinary(text[at : m.start()])
            out += quick._encode_single_piece(text[m.start() : end])
            at = end
        return out + quick.encode_ordinary(text[at:]) if at else quick.encode_ordinary(text)

    return lambda text: slow(text) if SPECIAL in text else fast(text)


class Windows:
    """A fixed number of open windows; a piece goes to the fullest one that it fits."""

    def __init__(self, n: int, size: int, first_id: int):
        self.n, self.size, self.next = n, size, first_id
        self.open: list[tuple[int, int, list]] = []  # (tokens, age, items), by tokens
        self.age = 0

    def put(self, length: int, items: list) -> list[tuple[int, list]]:
        """Places ``items`` of ``length`` tokens; returns windows (id, items) that were emitted."""
        out = []
        k = bisect.bisect_right(self.open, self.size - length, key=lambda w: w[0]) - 1
        if k >= 0:
            used, _, held = self.open.pop(k)
        else:
            if len(self.open) == self.n:
                out.append(self.emit(self.n - 1))
            used, held = 0, []
        self.age += 1
        bisect.insort(self.open, (used + length, self.age, held + items))
        if used + length == self.size:
            out.append(self.emit(len(self.open) - 1))
        return out

    def emit(self, k: int) -> tuple[int, list]:
        self.next += 1
        return self.next - 1, self.open.pop(k)[2]


def _rows(sequence: int, items: list, left: bool, keep_ids: bool = True) -> list[tuple]:
    at, out = 0, []
    for item in items:
        out.append((*item[:-1], item[-1] if keep_ids else None, sequence, at, left))
        at += item[2]
    return out


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, FIELDS, strict=True)], [n for n, _ in FIELDS])


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = WINDOW, open_windows: int = 512, keep_ids: bool = True) -> DataFrame:
    """Pieces of documents in windows of ``window`` tokens.

    Each document's ids are followed by id 0. Documents longer than a window are cut into whole
    windows and a tail; tails and short documents are placed best-fit in ``open_windows`` windows per
    partition, the fullest of which is emitted when none fits. What is still open at the end of a
    partition is merged in a second, much smaller pass over all partitions' leftovers, dealt by
    partition number so that no task gets them all; there pieces are cut to fill windows exactly.
    Null text: empty (one piece, the id 0). Null and repeated doc_ids are packed like others; an
    empty table gives no rows; other columns are ignored. ``ids`` holds little-endian unsigned 32-bit ids (null without ``keep_ids``).
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, space, out = tokenizer(json_path, ranks_path), Windows(open_windows, window, part << 40), []
        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.asarray([*encode(cell.as_py() or ""), 0], dtype="<u4")
                for lo in range(0, len(ids), window):
                    cut = ids[lo : lo + window]
                    raw = cut.tobytes()
                    item = (doc_id, lo, len(cut), zlib.crc32(raw), len(ids), raw)
                    for sequence, items in space.put(len(cut), [item]) if len(cut) < window else [(space.next, [item])]:
                        out += _rows(sequence, items, False, keep_ids)
                    space.next += len(cut) == window
            if len(out) > 4_000:
                yield _batches(out)
                out = []
        for k, (_, _, items) in enumerate(space.open):
            out += _rows((part << 40) + k, items, True)
        yield _batches(out)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, used, out = (1 << 62) + (TaskContext.get().partitionId() << 40), 0, []
        for batch in batches:
            for doc_id, start, _, _, total, ids, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while ids:
                    cut, ids = ids[: 4 * (window - used)], ids[4 * (window - used) :]
                    out.append((doc_id, start, len(cut) // 4, zlib.crc32(cut), total, cut if keep_ids else None, sequence, used, False))
                    start, used = start + len(cut) // 4, used + len(cut) // 4
                    if used == window:
                        sequence, used = sequence + 1, 0
            yield _batches(out)
            out = []

    placed = (stored if keep_ids else durable)(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(first, PIECES))
    # about 16 partitions' leftovers to a task
    groups = placed.where("left").agg(F.max(F.shiftright("sequence_id", 40))).first()[0]
    left = placed.where("left").repartition(((groups or 0) + 16) // 16, F.shiftright("sequence_id", 40)).sortWithinPartitions("sequence_id", "offset")
    return placed.where("not left").union(durable(left.mapInArrow(second, PIECES))).drop("left")
