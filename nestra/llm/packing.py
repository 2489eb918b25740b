"""Hierarchical multi-length packing of documents into training sequences.

Each task packs what it reads, in one pass with a bounded buffer, so there is
no shuffle and no place where all lengths meet. Full windows are cut off first;
a document's rest goes to the tier of the smallest window that holds it. When
the buffer is full, the long windows are filled: their own pieces first, gaps
from the shorter tiers (best fit, the last filler cut to measure). What is left
in a tier fills windows of that tier. Only at the end of a task are windows
shorter than the shortest tier used, again powers of two, so that no sequence
is padded at all. The sequences of a tier are dealt into step groups of equal
token counts, the heaviest (by the square of piece lengths) to the lightest
group.

Cases: a null text is empty and has one token, the closing id. Repeated rows
are packed once each. An empty table gives no pieces. A text of any length is
encoded whole and cut into full windows as it comes. Only doc_id and text are
read. Ids of sequences and groups are unique; which documents share a sequence
depends on how the input files are split, while a task that is run again over
the same split gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from nestra.llm import token_ids

TIERS = (1024, 512, 256, 128)
#: Tokens in a step group, whatever the tier of its sequences.
STEP_TOKENS = 16 * 1024
#: Tokens of rests that a task holds back before it packs them.
BUFFER_TOKENS = 256 * 1024
#: Sequence and group ids count upwards from the task's number times this.
IDS_PER_TASK = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the pieces of one task; `out` collects the rows that are ready."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = False):
        self.tiers, self.step_tokens, self.buffer_tokens, self.with_ids = tuple(sorted(tiers, reverse=True)), step_tokens, buffer_tokens, with_ids
        self.next_sequence = self.next_group = task * IDS_PER_TASK
        self.pools: dict[int, list] = {t: [] for t in self.tiers}  # pieces (doc_id, doc_tokens, start, ids)
        self.held = 0
        self.closed: dict[int, list] = {}  # sequences of a length that wait for a step group
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        window, n = self.tiers[0], len(ids)
        whole = n - n % window
        for start in range(0, whole, window):
            self._close([(doc_id, n, start, ids[start : start + window])])
        if whole < n:
            self._hold((doc_id, n, whole, ids[whole:].copy()))
        if self.held >= self.buffer_tokens:
            self._pack()

    def finish(self) -> None:
        self._pack()
        rest = [p for pool in self.pools.values() for p in pool]
        self.pools = {t: [] for t in self.tiers}
        left, size = sum(len(p[3]) for p in rest), self.tiers[0]
        while left:
            while size > left:
                size //= 2
            rest = self._fill(size, rest)
            left -= size
        for length in sorted(self.closed):
            self._deal(length, everything=True)

    def _hold(self, piece: tuple) -> None:
        self.pools[min(t for t in self.tiers if t >= len(piece[3]))].append(piece)
        self.held += len(piece[3])

    def _fill(self, size: int, pieces: list) -> list:
        """Closes one sequence of `size` tokens with pieces from the front, the last cut; returns the others."""
        taken, room = [], size
        for i, piece in enumerate(pieces):
            doc_id, n, start, ids = piece
            taken.append((doc_id, n, start, ids[:room]))
            if len(ids) >= room:
                self._close(taken)
                return ([(doc_id, n, start + room, ids[room:])] if len(ids) > room else []) + pieces[i + 1 :]
            room -= len(ids)
        raise ValueError("too few tokens to fill the sequence")

    def _pack(self) -> None:
        """Packs each tier, long windows first, as far as the tokens at hand fill whole windows."""
        for at, window in enumerate(self.tiers):
            own = sorted(self.pools[window], key=lambda p: -len(p[3]))
            self.pools[window] = []
            shorter = [self.pools[t] for t in self.tiers[at + 1 :]]
            for pool in shorter:
                pool.sort(key=lambda p: len(p[3]))
            for piece in own:
                taken, room = [piece], window - len(piece[3])
                while room and (pool := next((p for p in shorter if p and len(p[0][3]) <= room), None) or next((p for p in shorter if p), None)):
                    filler = self._best(pool, room)
                    doc_id, n, start, ids = filler
                    taken.append((doc_id, n, start, ids[:room]))
                    if len(ids) > room:
                        rest = (doc_id, n, start + room, ids[room:])
                        home = self.pools[min(t for t in self.tiers if t >= len(rest[3]))]
                        home.append(rest)
                        if home is not self.pools[window]:
                            home.sort(key=lambda p: len(p[3]))
                    room -= min(room, len(ids))
                if room:
                    self.pools[window] += taken
                else:
                    self._close(taken)
            kept = self.pools[window]
            left = sum(len(p[3]) for p in kept)
            while left >= window:
                kept = self._fill(window, kept)
                left -= window
            self.pools[window] = []
            for piece in kept:
                self.pools[min(t for t in self.tiers if t >= len(piece[3]))].append(piece)
        self.held = sum(len(p[3]) for pool in self.pools.values() for p in pool)

    @staticmethod
    def _best(pool: list, room: int) -> tuple:
        """Takes the longest piece that fits out of a pool sorted by length, else the shortest."""
        low, high = 0, len(pool)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if len(pool[mid][3]) <= room else (low, mid)
        return pool.pop(max(0, low - 1))

    def _close(self, pieces: list) -> None:
        length = sum(len(p[3]) for p in pieces)
        self.closed.setdefault(length, []).append(pieces)
        if len(self.closed[length]) * length >= 4 * self.step_tokens:
            self._deal(length)

    def _deal(self, length: int, everything: bool = False) -> None:
        """Deals the waiting sequences of a length into step groups of equal size and even weight."""
        size = max(1, self.step_tokens // length)
        waiting = self.closed.pop(length)
        n_groups = -(-len(waiting) // size) if everything else len(waiting) // size
        cost = lambda pieces: sum(len(p[3]) ** 2 for p in pieces)
        heap = [(0, g, 0) for g in range(n_groups)]
        for pieces in sorted(waiting, key=cost, reverse=True):
            weight, g, count = heapq.heappop(heap)
            offset = 0
            for doc_id, n, start, ids in pieces:
                row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_sequence, offset, length, self.next_group + g)
                self.out.append((*row, ids.tolist()) if self.with_ids else row)
                offset += len(ids)
            self.next_sequence += 1
            if count + 1 < size:
                heapq.heappush(heap, (weight + cost(pieces), g, count + 1))
        self.next_group += n_groups


def pack(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece of (doc_id, text); with_ids adds the piece's ids. Tiers are powers of two."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    vocabulary = vocabulary or token_ids.default_vocabulary()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, buffer_tokens, with_ids)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[] for _ in names]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids.encode(text.as_py() or "", vocabulary)
                packer.add(doc_id, np.append(ids, np.uint32(0)))
                if len(packer.out) >= (512 if with_ids else 8192):
                    yield ready()
        packer.finish()
        yield ready()

    return docs.select("doc_id", "text").mapInArrow(rows, schema)
