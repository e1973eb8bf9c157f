"""Alignment of two tokenizers' tokens, with corpus-wide counts of the id pairs whose tokens end together.

A is a byte-level tokenizer over space and text, B a piece model that adds the space itself; both spell out the same bytes. Offsets where
tokens of both end cut a text into groups; the A and the B token that end there are a link.

The counts come in two passes over the documents. In the first, each task sums the pairs of its documents. Their distinct keys are united in a
tree and get a minimal perfect hash; each task's counts become a dense vector indexed by it, and the vectors are summed in a tree of bounded
fan-in. The second pass aligns the documents again and looks the counts up, checking the key in the slot.

Of two tokens that end together one is the end of the other. So the vocabularies alone bound the pairs, whatever the corpus (`pair_bound`;
about 0.2 million for the public files), and the hash, its keys and the counts may go to the driver and to every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenframe.llm import units as U
from burdenframe.plans.workspace import stored

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Vectors that one task sums at a time.
FAN_IN = 16
SPACE = "▁"


class Aligner:
    """Both tokenizers, and for each unit its tokens, groups and links."""

    _of: dict[tuple, Aligner] = {}

    def __init__(self, byte_level: str | None, pieces: str | None):
        import sentencepiece

        if pieces is None:
            import public_tokenizers

            pieces = public_tokenizers.path(PIECES)
        self.a = U.Encoder(*U.Encoder.place(BYTE_LEVEL, byte_level), plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte_of = {c: b for b, c in U.byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.b_bytes = {}
        spelled = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.b_bytes[i] = piece.replace(SPACE, " ").encode()
                spelled.append(piece)
        self.space = self.b.piece_to_id(SPACE)
        self.cuts = U.PieceCuts(spelled, SPACE)
        self.numbers = pa.array([str(i) for i in range(max(max(self.a_bytes), max(self.b_bytes)) + 1)])
        self.memory = U.Memory(self._compute)

    @classmethod
    def at(cls, byte_level: str | None = None, pieces: str | None = None) -> Aligner:
        """One for each pair of files and worker process, with its memory."""
        if (byte_level, pieces) not in cls._of:
            cls._of[byte_level, pieces] = cls(byte_level, pieces)
        return cls._of[byte_level, pieces]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Units of space and text."""
        return self.cuts(U.spaced(texts))

    def _pieces(self, parts: list[str]) -> list[list[int]]:
        """B's ids. B puts a space before what it reads: it stands for a unit's own, and elsewhere a line feed parts it from the unit."""
        found = self.b.encode([u[1:] if u[:1] == " " else "\n" + u for u in parts], num_threads=1)
        return [[self.space] if u == " " else ids if u[:1] == " " else ids[2:] for u, ids in zip(parts, found)]

    def _compute(self, parts: list[str]) -> pa.Table:
        a, b = self.a.ids(parts), self._pieces(parts)
        fits = np.zeros(len(parts), bool)
        for i, (unit, x, y) in enumerate(zip(parts, a, b)):
            spelled = unit.encode()
            fits[i] = (b"".join([self.a_bytes.get(t, b"") for t in x]) == spelled and b"".join([self.b_bytes.get(t, b"") for t in y]) == spelled)
            if not fits[i]:
                a[i] = b[i] = []
        return self._aligned(U.lists(a, pa.int64()), U.lists(b, pa.int64()), fits)

    def _aligned(self, a: pa.ListArray, b: pa.ListArray, fits: np.ndarray) -> pa.Table:
        n = len(fits)
        n_a, n_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        ids_a, ids_b = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
        # units one after the other: the offsets of one are never those of another
        ends_a, ends_b = (np.cumsum(np.fromiter((len(of[t]) for t in ids.tolist()), np.int64, len(ids)))
                          for ids, of in ((ids_a, self.a_bytes), (ids_b, self.b_bytes)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        unit_a, unit_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        groups = np.bincount(unit_a[last_a], minlength=n)
        # tokens in the order of the text form: by group, A before B; each with the mark that follows it
        group = np.concatenate([np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(2 * group + side, kind="stable")
        marks = np.zeros(len(order), np.int8)
        marks[last_a], marks[len(ids_a) + last_b] = 1, 2
        words = pc.binary_join_element_wise(self.numbers.take(pa.array(np.concatenate([ids_a, ids_b])[order])),
                                            pa.array([",", "|", ";"]).take(pa.array(marks[order])), "")
        ends = np.append(0, np.cumsum(n_a + n_b)).astype(np.int32)
        return pa.table({
            "fits": fits, "n_a": n_a, "n_b": n_b, "n_groups": groups.astype(np.int64),
            "links": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)).astype(np.int32)), pa.array(ids_a[last_a] << 32 | ids_b[last_b])),
            "form": pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), ""),
        })

    def pair_bound(self) -> int:
        """How many id pairs can end together: of the two byte strings one must be the end of the other."""
        of = [{}, {}]
        for counts, tokens in zip(of, (self.a_bytes, self.b_bytes)):
            for t in tokens.values():
                counts[t] = counts.get(t, 0) + 1
        longer = sum(n * of[1].get(t[k:], 0) for t, n in of[0].items() for k in range(len(t)))
        return longer + sum(n * of[0].get(t[k:], 0) for t, n in of[1].items() for k in range(1, len(t)))


class Texts:
    """The aligned units of some texts: ``rows`` of the distinct ones, ``at`` of each in order, ``ends`` of the texts, and which texts count."""

    def __init__(self, aligner: Aligner, texts: pa.Array):
        self.rows, self.at, self.ends = aligner.memory.spread(aligner.cut(texts))
        self.valid = (self.sums(~self.numbers("fits")) == 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)

    def numbers(self, name: str) -> np.ndarray:
        return U.column(self.rows, name).to_numpy(zero_copy_only=False)

    def sums(self, of_rows: np.ndarray) -> np.ndarray:
        """Per text, the sum over its units."""
        total = np.append(0, np.cumsum(of_rows[self.at].astype(np.int64)))
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the distinct units, and where each unit's begin, and the end."""
        found = U.column(self.rows, "links")
        return found.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key has a slot of its own, from 0 on.

    On every level the keys left over from the levels before are thrown at as many places as there are keys; a key alone on its place stays. A
    slot is the rank of the place among those taken. ``keys`` holds the key of each slot, for verification.
    """

    def __init__(self, keys: np.ndarray):
        left, taken, self.sizes = np.asarray(keys, np.int64), [], []
        while len(left):
            places = (_mixed(left, len(self.sizes)) % np.uint64(len(left))).astype(np.int64)
            alone = np.bincount(places, minlength=len(left)) == 1
            taken.append(alone)
            self.sizes.append(len(left))
            left = left[~alone[places]]
        self.taken = np.concatenate(taken) if taken else np.zeros(0, bool)
        self.rank = np.cumsum(self.taken, dtype=np.int32) - self.taken
        self.keys = np.zeros(len(keys), np.int64)
        slots = self._slots(keys)
        self.keys[slots] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            places = base + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            own = self.taken[places]
            out[left[own]] = self.rank[places[own]]
            left, base = left[~own], base + size
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for others."""
        keys = np.asarray(keys, np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._slots(keys)
        return np.where(self.keys[out] == keys, out, -1)


def tree(parts: DataFrame, merge, fan_in: int = FAN_IN) -> np.ndarray:
    """The merged ``data`` (64-bit numbers) of all parts, which have dense ``node`` numbers: a task merges at most ``fan_in`` at a time."""
    schema = pa.schema([("node", pa.int64()), ("data", pa.binary())])

    def together(key, table):
        merged = merge([np.frombuffer(d, np.int64) for d in table.column("data").to_pylist()])
        return pa.table([[key[0].as_py()], [merged.astype(np.int64).tobytes()]], schema=schema)

    nodes = (parts.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInArrow(together, "node long, data binary")
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            row = parts.select("data").first()
            return np.frombuffer(row.data, np.int64) if row else np.zeros(0, np.int64)
        parts = stored(parts, "tree")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def pair_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str | None = None,
                pieces: str | None = None) -> tuple[PerfectHash, np.ndarray]:
    """The first pass: the hash of all linked id pairs (A id times 2**32 plus B id), and their numbers of links by slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, keys, counts = Aligner.at(byte_level, pieces), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for table in U.chunks(batches):
            texts = Texts(aligner, U.texts_of(table))
            weights = np.repeat(texts.valid, np.diff(texts.ends))
            times = np.bincount(texts.at[weights], minlength=texts.rows.num_rows)
            links, begins = texts.links()
            new = summed(links, np.repeat(times, np.diff(begins)))
            keys, counts = summed(np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]]))
        met = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([keys[met].tobytes()], pa.binary()),
                                          pa.array([counts[met].tobytes()], pa.binary())], ["node", "keys", "counts"])

    parts = stored(_texts(docs, doc_id, text).mapInArrow(count, "node long, keys binary, counts binary"), "pair-counts")
    keys = tree(parts.select("node", F.col("keys").alias("data")), lambda xs: np.unique(np.concatenate(xs)))
    slots = PerfectHash(keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own, n in zip(*(batch.column(c).to_pylist() for c in ("node", "keys", "counts"))):
                vector = np.zeros(len(slots.keys), np.int64)
                vector[slots.slots(np.frombuffer(own, np.int64))] = np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([vector.tobytes()], pa.binary())], ["node", "data"])

    return slots, tree(parts.mapInArrow(dense, "node long, data binary"), lambda xs: np.sum(xs, axis=0))


_ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str | None = None, pieces: str | None = None,
          with_groups: bool = False) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, how many links have their B id's highest count, the sum of the links'
    counts, and the hash of the groups as text (``with_groups``: the text too).

    Null and empty texts, and texts that one of the tokenizers doesn't spell out byte by byte, have zeros and an empty hash, and count nowhere.
    Texts may be of any length; repeated rows count as often as they occur; an empty table gives an empty table; other columns are left out,
    whatever their names.
    """
    slots, counts = pair_counts(docs, doc_id, text, byte_level, pieces)
    highest = np.zeros(int((slots.keys & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, slots.keys & 0xFFFFFFFF, counts)
    best = counts == highest[slots.keys & 0xFFFFFFFF]
    names = ["doc_id", *_ALIGNED, "groups_sha256"] + ["groups"] * with_groups

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.at(byte_level, pieces)
        for table in U.chunks(batches):
            texts = Texts(aligner, U.texts_of(table))
            links, begins = texts.links()
            at = slots.slots(links)
            known = at >= 0  # a unit may occur in texts that don't count only
            per_unit = []
            for values in (known & best[at], np.where(known, counts[at], 0)) if len(counts) else (known, known):
                total = np.append(0, np.cumsum(values.astype(np.int64)))
                per_unit.append(total[begins[1:]] - total[begins[:-1]])
            of = {name: texts.numbers(name) for name in ("n_a", "n_b", "n_groups")}
            of |= {"n_links": np.diff(begins), "n_best": per_unit[0], "count_sum": per_unit[1]}
            out = [U.column(table, "doc_id"), *[pa.array(np.where(texts.valid, texts.sums(of[name]), 0)) for name in _ALIGNED]]
            forms = U.column(texts.rows, "form").take(pa.array(texts.at))
            forms = pc.binary_join(pa.ListArray.from_arrays(pa.array(texts.ends.astype(np.int32)), forms), "").to_pylist()
            forms = [form[:-1] if valid else "" for form, valid in zip(forms, texts.valid.tolist())]
            out.append(pa.array([hashlib.sha256(f.encode()).hexdigest() if f else "" for f in forms], pa.string()))
            yield pa.RecordBatch.from_arrays(out + [pa.array(forms, pa.string())] * with_groups, names)

    schema = ", ".join(["doc_id long", *[f"{n} long" for n in _ALIGNED], "groups_sha256 string"] + ["groups string"] * with_groups)
    return _texts(docs, doc_id, text).mapInArrow(look_up, schema)
