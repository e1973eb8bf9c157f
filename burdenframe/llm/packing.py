"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Large items (over a third of the capacity) pair at most twice per sequence by greedy matching: the largest item left
goes with the largest other large item that fits. Smaller items then go, in descending order, each into the sequence
with the smallest gap that holds it.

Lengths are whole numbers from 1 to the capacity, so the decisions need the number of pieces of each length only: a
histogram of at most ``capacity`` rows reaches the driver, whatever the number of documents. The resulting plan says
where the r-th piece of each length goes; every task places its own pieces by their ranks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burdenframe.llm import units
from burdenframe.llm.common import only, record_batch
from burdenframe.plans.workspace import stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, seq long"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece, numbered inside its task and length.

    A document is its ids, then id 0. Only documents longer than the capacity are cut. A null or empty text is the
    single id 0. ``with_ids`` adds ``ids``, the ids of the piece.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("seq", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
    end = np.array([END_ID], "<u4").tobytes()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = units.Encoder.at(TOKENIZER, tokenizer), TaskContext.get().partitionId(), Counter()
        for table in units.chunks(rows):
            ids, ends = encoder.encode(units.texts_of(table))
            data, ends, out = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist(), []
            for key, lo, hi in zip(units.column(table, "doc_id").to_pylist(), ends, ends[1:]):
                own = bytes(data[lo:hi]) + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    n = len(part) // 4
                    row = (key, k, at // 4, n, zlib.crc32(part), task, seen[n])
                    out.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
                    seen[n] += 1
            if out:
                yield record_batch(schema, *zip(*out))

    return only(docs, doc_id=doc_id, text=text).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: rows of (length, first rank, first sequence, pieces per sequence, offset).

    A row holds for ranks up to the next row of its length; ranks fill sequence after sequence.
    """
    left = {n: c for n, c in histogram.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    rank: Counter = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, how many)
    order: list[int] = []  # gaps in use, ascending
    opened = 0

    def put(length: int, first: int, sequences: int, each: int, offset: int, n: int | None = None) -> None:
        rows.append((length, rank[length], first, each, offset))
        rank[length] += sequences * each if n is None else n

    def keep(gap: int, first: int, sequences: int) -> None:
        if sequences:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, sequences))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] == 1:  # it needs another partner than itself
            at -= 1
            b = large[at] if at >= 0 else 0
        if b == a:
            n = left[a] // 2
            put(a, opened, n, 2, 0)
            left[a] -= 2 * n
        elif b:
            n = min(left[a], left[b])
            put(a, opened, n, 1, 0)
            put(b, opened, n, 1, a)
            left[a], left[b] = left[a] - n, left[b] - n
        else:
            n = left[a]
            put(a, opened, n, 1, 0)
            left[a] = 0
        keep(capacity - a - b, opened, n)
        opened += n
        large = [x for x in large if left[x]]

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                more = -(-left[n] // (capacity // n))
                keep(capacity, opened, more)
                opened += more
                continue
            gap = order[at]
            first, sequences = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each, offset = gap // n, capacity - gap
            full = min(sequences, left[n] // each)
            if full:
                put(n, first, full, each, offset)
                keep(gap - each * n, first, full)
                left[n] -= full * each
            if full < sequences and left[n]:
                put(n, first + full, 1, left[n], offset, left[n])
                keep(gap - left[n] * n, first + full, 1)
                left[n], full = 0, full + 1
            keep(gap, first + full, sequences - full)
    return rows


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence and offset; ``cut`` is read three times, so store it first."""
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    rows = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    by_length: dict[int, np.ndarray] = {}
    for row in rows:
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {n: np.array(v, np.int64) for n, v in by_length.items()}
    kept = [f.name for f in cut.schema.fields if f.name not in ("task", "seq")]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            length = f.column("length").to_numpy()
            r = f.column("base").to_numpy() + f.column("seq").to_numpy()
            where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, steps = length == n, by_length[int(n)]
                step = steps[np.searchsorted(steps[:, 0], r[own], "right") - 1]
                k = r[own] - step[:, 0]
                where[own] = step[:, 1] + k // step[:, 2]
                offset[own] = step[:, 3] + n * (k % step[:, 2])
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in kept], pa.array(where), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if "ids" in kept else ""
    return cut.join(bases, ["length", "task"]).select(*kept, "seq", "base").mapInArrow(
        locate, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """Sequences of at most ``capacity`` tokens: one row per piece with its ``sequence_id`` and ``offset``.

    Null and empty texts are pieces of one token; repeated rows are packed as often as they occur; an empty table gives
    an empty table; columns other than the two named are left out, whatever their names. Pieces of a sequence follow
    each other without gaps from offset 0. ``with_ids`` keeps the token ids, for ``sequences``.
    """
    return place(stored(pieces(docs, doc_id, text, capacity, tokenizer, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, of a table packed ``with_ids``. A group holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
