"""Packing (operator 2): hierarchical packing into windows of several lengths.

A document's ids are cut into whole longest windows; the rest is routed to the smallest tier that holds it. Tiers are
packed from the longest down: a tier's window starts with one of its pieces, and the gap is filled with the longest
pieces that fit from the shorter tiers, the last of them cut to the gap. If nothing shorter is left, the piece itself is
cut down to the next tier. So every window is full (a power of two, which needs no padding) but one at the end of
each partition. Windows of a tier are then dealt into step groups, heaviest first and back and forth, so that the
groups of a block have about the same attention cost (sum of squared piece lengths).

All of it happens in the task that read the documents: no shuffle. What a task holds is one block of ids
(``BLOCK`` bytes of text, or one longer text) and less than one shortest window carried over.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by one; a null doc_id stays null; an
empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied
from .encoding import encoder

TIERS = (256, 512, 1024, 2048)
STEP = 8
BLOCK = 4_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Pieces by length. A piece is (row, start in its document, length)."""

    def __init__(self, longest: int):
        self.by = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, piece) -> None:
        self.by[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def longest(self, most: int):
        """Takes the longest piece of at most ``most`` ids; None if there is none."""
        m = self.mask & ((1 << (most + 1)) - 1)
        if not m:
            return None
        n = m.bit_length() - 1
        piece = self.by[n].pop()
        if not self.by[n]:
            self.mask &= ~(1 << n)
        return piece


def pack_block(pieces: list[tuple], tiers=TIERS, last: bool = False) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Windows (tier, pieces) of a block, and what is carried on: less than the shortest tier, or nothing if ``last``."""
    longest = tiers[-1]
    pool, windows = Pool(longest), []
    for row, start, n in pieces:
        while n >= longest:
            windows.append((longest, [(row, start, longest)]))
            start, n = start + longest, n - longest
        if n:
            pool.put((row, start, n))
    for i in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[i], tiers[i - 1] if i else 0
        while pool.mask >> (below + 1):
            piece = pool.longest(tier)
            window, gap = [piece], tier - piece[2]
            if i == 0:  # the shortest tier fills its gaps from itself
                below = tier
            while gap:
                filler = pool.longest(min(gap, below))
                if filler is None:
                    filler = pool.longest(below)  # longer than the gap: cut it
                    if filler is None:
                        break
                    row, start, n = filler
                    pool.put((row, start + gap, n - gap))
                    filler = (row, start, gap)
                window.append(filler)
                gap -= filler[2]
            if i == 0:
                below = 0
            if gap and i:  # nothing shorter is left: close a window of the next tier with what there is
                ids = [p for p in window]
                total = tier - gap
                for t in reversed(tiers[:i]):
                    while total >= t:
                        part, need = [], t
                        while need:
                            row, start, n = ids.pop(0)
                            k = min(n, need)
                            part.append((row, start, k))
                            if k < n:
                                ids.insert(0, (row, start + k, n - k))
                            need -= k
                        windows.append((t, part))
                        total -= t
                for p in ids:
                    pool.put(p)
            elif gap:
                if last:
                    windows.append((tier, window))
                    continue
                return windows, window
            else:
                windows.append((tier, window))
    return windows, []


def step_groups(windows, step: int = STEP) -> list[int]:
    """For each window the number of its group in the block; a group has windows of one tier and about equal cost."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
        groups = max(1, len(own) // step)
        for k, i in enumerate(own):
            lap, at = divmod(k, groups)
            out[i] = first + (at if lap % 2 == 0 else groups - 1 - at)
        first += groups
    return out


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, end_id: int = 1, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """Pieces with their windows; ``with_ids`` adds each piece's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        enc, base = None, TaskContext.get().partitionId() << 40
        seq = group = 0
        held: dict[int, tuple] = {}  # row -> (doc_id, ids, doc_tokens) of what is carried on; ids from the start of its piece
        carried: list[tuple] = []

        def emit(windows, rows):
            nonlocal seq, group
            groups = step_groups(windows, step)
            cols: list[list] = [[] for _ in range(10)]
            for (tier, pieces), g in zip(windows, groups):
                at = 0
                for row, start, n in pieces:
                    doc, ids, shift, total = rows(row)
                    raw = ids[start - shift : start - shift + n].astype("<u4").tobytes()
                    for c, v in zip(cols, (doc, start, n, zlib.crc32(raw), total, base + seq, at, tier, base + group + g, raw)):
                        c.append(v)
                    at += n
                seq += 1
            group += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
            n = len(names) if with_ids else len(names) - 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])

        for batch in batches:
            if not batch.num_rows:
                continue
            enc = enc or encoder(tokenizer, end_id)
            doc_ids = batch.column(0).to_pylist()
            for first, ids, off in enc.slices(batch.column(1), BLOCK):
                sizes = np.diff(off).tolist()
                starts = off.tolist()

                def rows(row, ids=ids, starts=starts, first=first, sizes=sizes):
                    if row < 0:
                        return held[row]
                    return doc_ids[first + row], ids[starts[row] : starts[row + 1]], 0, sizes[row]

                windows, rest = pack_block(carried + [(i, 0, n) for i, n in enumerate(sizes)], tiers)
                if windows:
                    yield emit(windows, rows)
                kept = {}
                carried = []
                for k, (row, start, n) in enumerate(rest):
                    doc, x, shift, total = rows(row)
                    kept[-1 - k] = (doc, x[start - shift : start - shift + n].copy(), start, total)
                    carried.append((-1 - k, start, n))
                held.clear()
                held.update(kept)
        if carried:
            windows, _ = pack_block(carried, tiers, last=True)
            yield emit(windows, lambda row: held[row])

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
