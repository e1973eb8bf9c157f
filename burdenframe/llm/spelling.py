"""Groups of spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are one insertion, deletion or replacement apart if their common prefix and their common suffix together reach the longer length minus
one. Then one of the two is at least half as long as the longer word. So words meet in groups by such a half: for a longer length ``m``, all
words of length ``m`` and ``m - 1`` with the same first (or last) ``m // 2`` code points. The words of a group are rows of code-point matrices, one
padded on the right, one on the left; tiles of rows are compared whole, column by column, and hand on only what each word has found: how many
words are near and which is the most frequent. Groups beyond a block are dealt into blocks, and each pair of blocks is a tile of its own
somewhere in the cluster, so no task holds more of a group than two blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenframe.llm import units
from burdenframe.plans.workspace import stored

LETTERS = rb"[a-z\xc0-\xff]+"
SLIP, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words of a block; rows of a tiling task; words that a counting task holds; cells that a tile compares at a time.
BLOCK, TASK_ROWS, HELD, CELLS = 4096, 100_000, 500_000, 2_000_000


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n``: runs of Latin letters with A to Z in lower case, after the rule that drops a letter of some of them, with at least so
    many code points and occurrences. A null doc_id reads as an empty one in that rule."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        runs, crc32 = re.compile(LETTERS).findall, zlib.crc32

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for table in units.chunks(batches):
            for key, value in zip(units.column(table, "doc_id").to_pylist(), units.column(table, "text").to_pylist()):
                # one byte per code point; what is beyond the letters' range becomes a question mark
                found = Counter(runs((value or "").encode("latin-1", "replace").lower()))
                begun = crc32(f"{'' if key is None else key}:".encode())
                for run, n in found.items():
                    if len(run) < least_length:
                        continue
                    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                    if not h % SLIP:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    held[run] += n
            if len(held) >= HELD:
                yield handed()
        if held:
            yield handed()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def groups(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each word in its four groups, ``side`` (by prefix or suffix), longer length ``m`` and the ``half`` in common; in groups beyond a block, in
    every pair of blocks (``lo``, ``hi``) that has its own."""
    size = F.char_length("word")
    both = F.explode(F.array(size, size + 1)).alias("m")
    half = lambda side: F.substring("word", 1, F.floor(F.col("m") / 2).cast("int")) if side else F.right("word", F.floor(F.col("m") / 2).cast("int"))
    sides = F.array(*[F.struct(F.lit(bool(s)).alias("prefix"), half(s).alias("half")) for s in (1, 0)])
    rows = counted.select("word", "n", both).select("word", "n", "m", F.explode(sides).alias("g")).select("word", "n", "m", "g.prefix", "g.half")
    key = ["prefix", "m", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows"))
    large = stored(sizes.filter(F.col("rows") > block).select(*key, F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "large-groups")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = rows.join(large, key, "left").withColumn("own", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    return dealt.select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "word", "n")


def shared_ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of the rows of ``x`` (b, s, w) with those of ``y`` (b, t, w), as (b, s, t)."""
    alive = np.ones((*x.shape[:2], y.shape[1]), bool)
    length = np.zeros(alive.shape, np.int16 if x.shape[2] < 1 << 14 else np.int32)
    for c in range(x.shape[2]):
        alive &= x[:, :, None, c] == y[:, None, :, c]
        if not alive.any():
            break
        length += alive
    return length


def near_rows(left: tuple, right: tuple, m: int, by_prefix: bool) -> np.ndarray:
    """Which words of two tiles are one edit apart and belong to this group: a pair with the half in common at both ends counts by prefix.

    A tile is (matrix padded on the right, matrix padded on the left, lengths); its padding rows have length 0.
    """
    (xp, xs, xn), (yp, ys, yn) = left, right
    begin, end = shared_ends(xp, yp), shared_ends(xs[:, :, ::-1], ys[:, :, ::-1])
    near = begin + end >= m - 1
    near &= (xn == m)[:, :, None] | (yn == m)[:, None, :]
    near &= (xn >= m - 1)[:, :, None] & (yn >= m - 1)[:, None, :]
    near &= begin < m if by_prefix else begin < m // 2  # not with itself
    return near


def tile(members: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrices and lengths of words of at most ``m`` code points."""
    lengths = np.fromiter(map(len, members), np.int64, len(members))
    text = lambda parts: np.frombuffer(b"".join(parts), np.uint8).reshape(len(members), m)
    return text([w.ljust(m, b"\0") for w in members]), text([w.rjust(m, b"\0") for w in members]), lengths


_FOUND = "word string, n_near long, near_n long, near string"


def _compare():
    """Sorted rows of groups to what each word found in them. Groups of about one size and length are compared together."""

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])

    def results(x: list[bytes], y: list[bytes], y_n: list[int], near: np.ndarray) -> list[tuple]:
        order = np.array(sorted(range(len(y)), key=lambda j: (-y_n[j], y[j])), np.int64)
        hit = np.flatnonzero(near.any(axis=1))
        first = order[near[hit][:, order].argmax(axis=1)] if len(hit) else hit
        return [(x[i].decode("latin-1"), int(n), y_n[j], y[j].decode("latin-1")) for i, n, j in zip(hit.tolist(), near[hit].sum(axis=1).tolist(), first.tolist())]

    def alone(group: tuple, members: list[tuple]) -> Iterator[tuple]:
        """One large group or pair of blocks, some rows of the one against all of the other."""
        by_prefix, m, lo, hi = group
        blocks = [[(w, n) for w, n, own in members if own == b] for b in ((lo,) if lo == hi else (lo, hi))]
        for x, y in ((blocks[0], blocks[-1]), (blocks[-1], blocks[0])) if len(blocks) > 1 else ((blocks[0], blocks[0]),):
            if not x or not y:
                continue
            yw, yn = [w for w, _ in y], [n for _, n in y]
            ty = [a[None] for a in tile(yw, m)]
            step = max(1, CELLS // len(y))
            for i in range(0, len(x), step):
                xw = [w for w, _ in x[i : i + step]]
                near = near_rows([a[None] for a in tile(xw, m)], ty, m, by_prefix)[0]
                yield from results(xw, yw, yn, near)

    def together(by_prefix: bool, m: int, width: int, small: list[list[tuple]]) -> Iterator[tuple]:
        """Small groups side by side, filled up to ``width`` words each."""
        filled = [w for g in small for w in [x[0] for x in g] + [b""] * (width - len(g))]
        shaped = [a.reshape(len(small), width, *a.shape[1:]) for a in tile(filled, m)]
        near = near_rows(shaped, shaped, m, by_prefix)
        for k in np.flatnonzero(near.any(axis=(1, 2))).tolist():
            own = [x[0] for x in small[k]]
            yield from results(own, own, [x[1] for x in small[k]], near[k, : len(own), : len(own)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[list[tuple]]] = {}
        out: list[tuple] = []

        def finished(group: tuple, members: list[tuple]) -> None:
            if len(members) < 2:
                return
            (by_prefix, m, _, lo, hi), width = group, 2
            while width < len(members):
                width *= 2
            if width > 64 or lo != hi or width * width * m > CELLS:
                out.extend(alone((by_prefix, m, lo, hi), members))
                return
            small = waiting.setdefault((by_prefix, m, width), [])
            small.append(members)
            if (len(small) + 1) * width * width > CELLS // 4:
                out.extend(together(by_prefix, m, width, waiting.pop((by_prefix, m, width))))

        def handed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()

        group, members = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("prefix", "m", "half", "lo", "hi")))
            for key, word, n, own in zip(keys, *(batch.column(c).to_pylist() for c in ("word", "n", "own"))):
                if key != group:
                    finished(group, members)
                    group, members = key, []
                members.append((word.encode("latin-1"), n, own))
            yield from handed()
        finished(group, members)
        for (by_prefix, m, width), small in waiting.items():
            out.extend(together(by_prefix, m, width, small))
        yield from handed()

    return compare


def near_words(counted: DataFrame, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """Of each word with near ones: ``n_near``, and the most frequent of them (``near``, ``near_n``; ties: the smallest)."""
    rows = groups(counted, block)
    tasks = -(-4 * counted.count() // task_rows) or 1
    key = ["prefix", "m", "half", "lo", "hi"]
    found = rows.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(_compare(), _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of a table of ``word`` and ``form``: forms followed to the last. Every round doubles the length of the way, and a form
    is several times as frequent as its word, so a few rounds are enough."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("via"), F.col("root").alias("further"))
        longer = ways.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved"))
        longer = stored(longer, "ways")
        ways = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return ways


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """One row per word with its occurrences ``n``, the number of near words, its ``form`` (the most frequent near word, if that occurs at least
    ``times`` as often) with ``form_n``, and its ``root``, where the forms end.

    Null and empty texts have no words; texts and words may be of any length; repeated rows count as often as they occur; an empty table gives an
    empty table; other columns are left out, whatever their names. Ties among near words go to the smallest in code-point order.
    """
    counted = stored(words(docs, doc_id, text), "words")
    near = near_words(counted, block)
    joined = counted.join(near, "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    judged = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"),
                                  F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
