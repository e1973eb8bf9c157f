"""N-gram Jaccard join with set-relation skipping.

Documents that share at least four fifths of their five-word shingles are linked; the result is the component of each.

1. Shingles are counted over all documents, in buckets of the hash range. What occurs once only can't be shared, so
   just the others go back to the chunk of sets that they came from. A set sorts them from rare to frequent and keeps a prefix: two sets that
   are similar enough must share a shingle of both prefixes. Most sets have no shared shingle in it and are done.
2. The prefixes make an index of lists. The entries of a list lie in blocks by set size; an entry at position ``i`` of a
   set of ``n`` leaves room for ``n - i`` common shingles. Blocks whose best entries leave too little room for any partner
   are skipped whole, entries then one by one.
3. Each set is first compared with the one set of its lists that has the earliest position, its pivot. Sets linked with
   one pivot are in one component, so nothing is computed among them. For pairs across components the overlaps with a
   common pivot bound the overlap from both sides: ``|x & p| + |y & p| - |p| <= |x & y| <= |y & p| + |x - p|``. Only
   what the bounds leave open is computed from the sets.

Equal sets are one node throughout. Shingles are 64-bit hashes: two different ones that collide count as equal.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.llm.common import only, record_batch
from burdenframe.llm.components import components
from burdenframe.plans.workspace import stored

WORDS = 5
#: Shingles that a task holds before it hands them on, and that a bucket holds on average.
CHUNK, BUCKET_CHARS = 500_000, 2_000_000
#: Buckets, and chunks' returns, that a task works off one after the other.
BUCKETS_PER_TASK = 4
#: A shingle in so many sets of a chunk is frequent: it sorts last, and its sets aren't brought together.
FREQUENT = 64
FREQUENT_DF = 1 << 40
KEPT_WORDS = 100_000
ROW = "key int, kind int, doc_id long, node long, n long, payload binary"
_ROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                  ("payload", pa.binary())])
#: Rows of documents, tables of a chunk's sets, chunks of shingles for a bucket, shared shingles for a chunk. In the
#: last three ``node`` is the chunk.
DOC, TABLE, PART, SHARED = range(4)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


_words = _Hashes()
_ODD, _MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences; of the whole text if it has fewer words; none without words."""
    found = (text or "").encode().lower().split()
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = h[:n] + np.uint64(k)
    for i in range(1, k):
        out = out * _ODD + h[i : n + i]
    for _ in range(2):
        out = (out ^ (out >> _HALF)) * _MIX
    out ^= out >> _HALF
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))


def node_of(text: Column, words: int = WORDS) -> Column:
    """The node of a text's set, null without words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        sets = (shingles(t.as_py(), words) for t in texts)
        nodes = pa.array([int(np.uint64(_node(s)).astype(np.int64)) if len(s) else None for s in sets], pa.int64())
        _words.clear()
        return nodes

    return run(text)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers, byte by byte of their significance, sorted ones as differences: that compresses well."""
    sizes, parts = [], []
    for a in arrays:
        ascending = bool(len(a) < 2 or (a[1:] >= a[:-1]).all())
        sizes.append(len(a) | ascending << 31)
        parts.append((np.diff(a, prepend=np.uint64(0)) if ascending else a).view(np.uint8).reshape(len(a), 8).T.tobytes())
    return struct.pack(f"<{len(arrays)}I", *sizes) + b"".join(parts)


def _unpack(data: bytes, arrays: int) -> list[np.ndarray]:
    at, out, view = 4 * arrays, [], memoryview(data)
    for size in struct.unpack_from(f"<{arrays}I", data):
        n = size & 0x7FFFFFFF
        a = np.frombuffer(view[at : at + 8 * n], np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if size >> 31 else a)
        at += 8 * n
    return out


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of all."""
    return np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else [], len(a)).astype(np.int64)


def _bucket_bounds(n: int) -> np.ndarray:
    """The least hash of each of ``n`` equal shares of the range, without the first."""
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def _rows(kind: int, keys, chunks, payloads) -> pa.RecordBatch:
    n = len(keys)
    return record_batch(_ROW, keys, [kind] * n, [None] * n, chunks, [None] * n, payloads)


def _split(key: np.ndarray, bounds: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Cut arrays sorted by ``key`` at the bounds."""
    cuts = [0, *np.searchsorted(key, bounds), len(key)]
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if hi > lo:
            yield b, [a[lo:hi] for a in arrays]


def _spread(turn) -> int:
    """Keys of rows that may go anywhere; buckets have keys from 0."""
    return -1 - next(turn) % 997


def _emit(buckets: int, words: int):
    """Documents to their sets' names and sizes; per chunk of sets a table of them, and its shingles by bucket."""
    bounds = _bucket_bounds(buckets)

    def flush(sets: dict[int, np.ndarray], turn) -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        chunk = (TaskContext.get().partitionId() << 32) + next(turn)
        nodes, sizes = np.fromiter(sets, np.uint64, len(sets)), np.fromiter(map(len, sets.values()), np.uint64, len(sets))
        yield _rows(TABLE, [_spread(turn)], [chunk], [_pack(nodes, sizes)])
        h, at = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint64), sizes.astype(np.int64))
        order = np.argsort(h)
        h, at = h[order], at[order]
        begins = _runs(h)
        times = np.diff(begins)
        often = np.repeat(times >= FREQUENT, times)
        loud = h[begins[:-1][times >= FREQUENT]]
        if len(loud):
            yield _rows(SHARED, [_spread(turn)], [chunk], [_pack(at[often], h[often], np.full(often.sum(), FREQUENT_DF, np.uint64))])
        h, at = h[~often], at[~often]
        louds, parts = dict(_split(loud, bounds, loud)), dict(_split(h, bounds, h, at))
        keys = sorted(louds.keys() | parts.keys())
        none = [h[:0], at[:0]]
        yield _rows(PART, keys, [chunk] * len(keys), [_pack(*parts.get(b, none), *louds.get(b, none[:1])) for b in keys])

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, sets, held = count(), {}, 0
        for batch in rows:
            keys, texts, out = batch.column("doc_id").to_pylist(), batch.column("text"), []
            for key, text in zip(keys, texts):
                s = shingles(text.as_py(), words)
                node = _node(s) if len(s) else None
                out.append((_spread(turn), DOC, key, None if node is None else np.uint64(node).astype(np.int64), len(s), None))
                if node is not None and node not in sets:
                    sets[node] = s
                    held += len(s)
                if held >= CHUNK:
                    yield from flush(sets, turn)
                    sets, held = {}, 0
            if out:
                yield record_batch(_ROW, *zip(*out))
        yield from flush(sets, turn)
        _words.clear()  # the worker goes on to other tasks

    return emit


def _passed(batch: pa.RecordBatch, kinds: np.ndarray, *which: int) -> Iterator[pa.RecordBatch]:
    rest = batch.filter(pa.array(np.isin(kinds, which)))
    if rest.num_rows:
        yield rest


def _count():
    """Per bucket of the hash range: who has the shingles that occur more than once, back to the chunks. Rows come sorted by bucket; other
    rows pass."""

    def shared(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        opened = [(_unpack(data, 3), i) for i, (_, data) in enumerate(parts)]
        h, at, loud = (np.concatenate([x[k] for x, _ in opened]) for k in range(3))
        chunk = np.repeat([i for _, i in opened], [len(x[0]) for x, _ in opened])
        order = np.argsort(h, kind="stable")
        h, at, chunk, loud = h[order], at[order], chunk[order], np.unique(loud)
        times = np.diff(_runs(h))
        df = np.repeat(times, times).astype(np.uint64)
        df[np.isin(h, loud)] = FREQUENT_DF
        keep = df > 1
        h, at, chunk, df = h[keep], at[keep], chunk[keep], df[keep]
        order = np.argsort(chunk, kind="stable")
        h, at, chunk, df = h[order], at[order], chunk[order], df[order]
        begins = _runs(chunk)
        payloads = [_pack(at[lo:hi], h[lo:hi], df[lo:hi]) for lo, hi in zip(begins, begins[1:])]
        if payloads:
            yield _rows(SHARED, [0] * len(payloads), [parts[i][0] for i in chunk[begins[:-1]]], payloads)

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in rows:
            kinds = batch.column("kind").to_numpy()
            yield from _passed(batch, kinds, DOC, TABLE, SHARED)
            for k in np.flatnonzero(kinds == PART):
                key = batch.column("key")[k].as_py()
                if key != bucket and parts:
                    yield from shared(parts)
                    parts = []
                bucket = key
                parts.append((batch.column("node")[k].as_py(), batch.column("payload")[k].as_py()))
        if parts:
            yield from shared(parts)

    return reduce


def _gather():
    """Sets whose prefix has a shared shingle: ``own``, how many occur nowhere else, and the shared ones from rare to frequent."""

    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def sets(table: bytes, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        nodes, sizes = _unpack(table, 2)
        at, tokens, df = map(np.concatenate, zip(*(_unpack(p, 3) for p in parts)))
        order = np.lexsort((tokens, df, at))
        at, tokens = at[order].astype(np.int64), tokens[order].astype(np.int64)
        begins, out = _runs(at), []
        for lo, hi in zip(begins, begins[1:]):
            n = int(sizes[at[lo]])
            own = n - int(hi - lo)
            if own < prefix(n):
                out.append((None, nodes[at[lo]].astype(np.int64), n, own, tokens[lo:hi]))
            if len(out) == 2000 or out and hi == len(at):
                yield record_batch(schema, *zip(*out))
                out = []

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, table, parts = None, b"", []
        for batch in rows:
            kinds = batch.column("kind").to_numpy()
            for docs in _passed(batch, kinds, DOC):
                n = docs.num_rows
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), docs.column("node"), docs.column("n"), pa.nulls(n, pa.int64()), pa.nulls(n, schema[4].type)], schema=schema)
            for k in np.flatnonzero(kinds != DOC):  # a chunk's table comes before its shingles
                own, payload = batch.column("node")[k].as_py(), batch.column("payload")[k].as_py()
                if kinds[k] == TABLE:
                    if parts:
                        yield from sets(table, parts)
                    chunk, table, parts = own, payload, []
                elif own != chunk:
                    raise ValueError("shingles without the table of their chunk")
                else:
                    parts.append(payload)
        if parts:
            yield from sets(table, parts)

    return gather


def prefix(n: int) -> int:
    """Length of a prefix that shares a shingle with that of every similar set."""
    return n - -(-4 * n // 5) + 1


def _similar(overlap: Column, sizes: Column) -> Column:
    """Intersection at least 0.8 of the union."""
    return overlap * 9 >= sizes * 4


def sets_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows of documents (doc_id, node, n) and, with ``own`` not null, of sets that may have partners (node, n, own, tokens)."""
    rows = only(docs, doc_id=doc_id, text=text)
    buckets = max(1, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS)
    tasks = -(-buckets // BUCKETS_PER_TASK)
    parts = rows.mapInArrow(_emit(buckets, words), ROW).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_count(), ROW)
    home = F.when(F.col("kind") == DOC, F.col("key").cast("long")).otherwise(F.col("node"))
    own = parts.repartition(tasks, home).sortWithinPartitions(home, "kind")
    return stored(own.mapInArrow(_gather(), "doc_id long, node long, n long, own long, tokens array<long>"), "sets")


def index(sets: DataFrame) -> DataFrame:
    """The lists: one entry per set and prefix shingle. ``room`` is how many shingles could still be common from there on."""
    n = F.col("n")
    kept = n - F.floor((n * 4 + 4) / 5) + 1 - F.col("own")
    tokens = F.posexplode(F.slice("tokens", F.lit(1), F.least(kept, F.size("tokens")).cast("int"))).alias("i", "token")
    lists = sets.select("node", "n", "own", tokens).select("token", "node", "n", (n - F.col("own") - F.col("i")).alias("room"))
    return lists.withColumn("block", F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes ``na``, ``nb`` and the number of common shingles, ``overlap``."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return pairs.join(one, "a").join(two, "b").withColumn("overlap", common).drop("ta", "tb")


def pivots(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Each set (``a``) compared with its pivot (``b``): the entry with the earliest position in any of its lists."""
    first = lists.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("room")).alias("at"), "node", "n", "room")).alias("p"))
    near = lists.join(first, "token").filter((F.col("node") != F.col("p.node")) & _similar(F.least("room", "p.room"), F.col("n") + F.col("p.n")))
    return overlaps(near.groupBy(F.col("node").alias("a")).agg(F.min("p").alias("p")).select("a", F.col("p.node").alias("b")), sets)


def across(lists: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a list, have room for enough in common and are in different components.

    In each list the component with most entries needs no comparison with itself, so only the other entries look for
    partners, in the blocks that sets of their size can reach and whose best entry leaves them room.
    """
    known = lists.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "lists")
    per = known.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = per.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1")
    open_lists = known.join(main.select("token", F.col("m.component").alias("main")), "token")
    blocks = open_lists.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("room").alias("best"))
    seek = open_lists.filter("component != main").withColumn("to", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    seek = seek.select("token", F.col("to").alias("block"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("room").alias("ra"),
                       F.col("component").alias("ca"))
    seek = seek.join(blocks, ["token", "block"]).filter(_similar(F.least("ra", "best"), F.col("na") + F.col("least"))).drop("least", "best")
    found = seek.join(open_lists, ["token", "block"]).filter(
        (F.col("ca") != F.col("component")) & _similar(F.least("ra", "room"), F.col("na") + F.col("n"))
        & ((F.col("component") == F.col("main")) | (F.col("a") < F.col("node"))))
    return found.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def links_across(pairs: DataFrame, compared: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among ``pairs``: from the overlaps with a common pivot where they decide, else from the sets."""
    sizes = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias("n" + x))
    seen = compared.select("a", "b", "nb", "overlap")
    own = seen.select(F.col("b").alias("a"), "b", "nb", F.col("nb").alias("overlap")).distinct()
    answers = seen.union(own)
    left = answers.select("a", F.col("b").alias("p"), F.col("nb").alias("np"), F.col("overlap").alias("oa"))
    right = answers.select(F.col("a").alias("b"), F.col("b").alias("p"), F.col("overlap").alias("ob"))
    both = pairs.join(sizes("a"), "a").join(sizes("b"), "b")
    via = both.join(left, "a").join(right, ["b", "p"])
    low, high = F.col("oa") + F.col("ob") - F.col("np"), F.least(F.col("ob") + F.col("na") - F.col("oa"), F.col("oa") + F.col("nb") - F.col("ob"))
    total = F.col("na") + F.col("nb")
    verdict = via.groupBy("a", "b").agg(F.max(_similar(low, total)).alias("sure"), F.min(_similar(high, total)).alias("possible"))
    judged = stored(pairs.join(verdict, ["a", "b"], "left"), "pairs")
    opened = judged.filter((F.coalesce("sure", F.lit(False)) == False) & F.coalesce("possible", F.lit(True))).select("a", "b")  # noqa: E712
    computed = overlaps(opened, sets).filter(_similar(F.col("overlap"), F.col("na") + F.col("nb"))).select("a", "b")
    return judged.filter("sure").select("a", "b").union(computed)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id that links reach, of every row.

    Words are what white space separates, with A to Z in lower case. A text with fewer words than a shingle has one
    shingle, all its words. Null and empty texts have none and link with nothing: their component is their own doc_id.
    Rows with a null doc_id get the smallest non-null doc_id of their component, or null. Repeated rows stay, in one
    component. An empty table gives an empty table. Other columns are left out.
    """
    return members(docs, doc_id, text, words).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``near_duplicates`` with the ``node`` of each row's set and the ``component`` of that node, null for texts without words.

    Components that have their smallest doc_id in common, by rows that share it, differ in ``component``.
    """
    rows = sets_of(docs, doc_id, text, words)
    documents, sets = rows.filter("own IS NULL"), rows.filter("own IS NOT NULL").select("node", "n", "own", "tokens")
    sets = stored(sets.dropDuplicates(["node"]), "nodes")
    lists = stored(index(sets), "index")
    compared = stored(pivots(lists, sets), "pivots")
    links = compared.filter(_similar(F.col("overlap"), F.col("na") + F.col("nb"))).select("a", "b")
    stars = stored(components(links), "stars")
    more = links_across(across(lists, stars), compared, sets)
    of = components(links.union(more))
    least = documents.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("node").alias("named"), "component", "component_id")
    return documents.join(named, F.col("node") == F.col("named"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id, or without doc_id if no row there has one; of rows
    with that doc_id the one whose set has the smallest node, and one of those with equal sets.

    Rows that share a doc_id but not a component are told apart by their sets. Of texts without words, null or empty, one of each doc_id stays.
    An empty table gives an empty table.
    """
    rows = stored(members(docs, doc_id, text, words), "members")
    of = [F.col("component"), F.when(F.col("component").isNull(), F.col("doc_id"))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("first")
    keep = stored(rows.groupBy(*of).agg(first).select(F.col("first.doc_id").alias("keep"), F.col("first.node").alias("keep_node")), "keep")
    again = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "again")
    kept = docs.join(keep, docs[f"`{doc_id}`"] == F.col("keep"), "left_semi")
    if again.isEmpty():
        return kept
    named = again.select(F.col("doc_id").alias("again"))
    unclear = docs.join(named, docs[f"`{doc_id}`"].eqNullSafe(F.col("again")), "left_semi")
    unclear = unclear.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), node_of(F.col(f"`{text}`"), words).alias("node"))
    chosen = unclear.join(keep, F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("keep")) & F.col("node").eqNullSafe(F.col("keep_node")), "left_semi")
    chosen = chosen.withColumn("id", F.col(f"doc.`{doc_id}`")).dropDuplicates(["id", "node"])
    return kept.join(named, kept[f"`{doc_id}`"] == F.col("again"), "left_anti").union(chosen.select(*[F.col(f"doc.`{c}`") for c in docs.columns]))
