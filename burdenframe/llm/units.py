"""Texts as units, short strings that tokenizers treat alone, and a bounded memory of what was computed for a unit.

Texts repeat their words. Cutting, looking up and joining run in Arrow over many texts at a time; only units that the memory
doesn't hold reach the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of Unicode, as regular expressions for Python and for Arrow.
WS = r"\t-\r \x85\xa0  -     　"
_WS_ARROW = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks cuts; a text that has it is cut in Python.
CUT = ""
#: Runs of white space whose cuts depend on what stands beside them.
_UNCLEAR = f"{_WS_ARROW}{{3}}|{_WS_ARROW} |{_WS_ARROW}{{2}}$|{CUT}"
_BEGINS = re.compile(f"(?<=[^{WS}])(?=[ \\n])")
#: Letters that stay one letter in lower case.
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
CHUNK_CHARS = 8_000_000


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """Consecutive rows with about ``most`` bytes of text, from batches of any size; a longer text is alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(ends, before + most - size, "right")), lo + (not held))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - before)
                lo = hi
            if lo < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.chunk(0) if found.num_chunks == 1 else found.combine_chunks() if found.num_chunks else pa.array([], found.type)


def texts_of(table: pa.Table, name: str = "text") -> pa.Array:
    return pc.fill_null(column(table, name), "")


def cut(texts: pa.Array, marks: bool = True, whole: list[str] = ()) -> pa.ListArray:
    """Units of each text, in order and without loss: a cut before a space or line feed, after a line feed, and with ``marks`` between a
    letter and a full stop or comma.

    Byte-level patterns and common piece vocabularies don't join across these cuts where white space comes singly; in texts with longer runs
    cuts stand only before the runs that begin with a space or line feed. Texts with a string of ``whole`` aren't cut.
    """
    unclear = pc.match_substring_regex(texts, _UNCLEAR)
    for w in whole:
        unclear = pc.or_(unclear, pc.match_substring(texts, w))
    plain = texts.filter(pc.invert(unclear))
    marked = pc.replace_substring(plain, "\n", f"{CUT}\n{CUT}")
    marked = pc.replace_substring(marked, " ", f"{CUT} ")
    if marks:
        marked = pc.replace_substring_regex(marked, r"(\pL)([.,])", f"\\1{CUT}\\2")
    units = pc.split_pattern(marked, CUT)
    if len(plain) == len(texts):
        return units
    rest = pa.array([[t] if any(w in t for w in whole) else _BEGINS.split(t) for t in texts.filter(unclear).to_pylist()], units.type)
    where = np.concatenate([np.flatnonzero(~(u := unclear.to_numpy(zero_copy_only=False))), np.flatnonzero(u)])
    return pa.concat_arrays([units, rest]).take(pa.array(np.argsort(where)))


def spaced(texts: pa.Array) -> pa.Array:
    """A space before each text that isn't empty."""
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))


class PieceCuts:
    """The units of a piece vocabulary that writes spaces as ``space``: as ``cut`` makes them if no piece joins across, else whole texts."""

    def __init__(self, pieces: list[str], space: str):
        self.apart = not any(space in p.lstrip(space) or "\n" in p for p in pieces)
        self.marks = not any(x.isalpha() and y in ".," for p in pieces for x, y in zip(p, p[1:]))

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        if self.apart:
            return cut(texts, marks=self.marks)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)


def folded_words(texts: pa.Array, whole: list[str] = ()) -> pa.ListArray:
    """Words for tokenizers that ignore case and white space: A to Z in lower case, full stops and commas apart from a Latin letter before them.

    Texts with a string of ``whole`` keep their case.
    """
    kept = pa.array(np.zeros(len(texts), bool))
    for w in whole:
        kept = pc.or_(kept, pc.match_substring(texts, w, ignore_case=True))
    spaced = pc.replace_substring(pc.if_else(kept, texts, pc.ascii_lower(texts)), "\n", " ")
    return pc.split_pattern(pc.replace_substring_regex(spaced, f"({_LATIN})([.,])", r"\1 \2"), " ")


class Memory:
    """What ``compute`` made of each unit: a table row per unit. Holds ``most`` units at most; if there are more, those met most often stay."""

    def __init__(self, compute: Callable[[list[str]], pa.Table], most: int = 500_000):
        self.compute, self.most = compute, most
        self.units, self.rows, self.met = pa.array([], pa.string()), None, np.zeros(0, np.float32)

    def of(self, units: pa.Array) -> pa.Table:
        """Rows of distinct ``units``, in their order."""
        at = pc.index_in(units, value_set=self.units)
        missing = units.filter(pc.is_null(at))
        where = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = where >= 0
        self.met[where[known]] += 1
        rows = self.rows
        if len(missing) or rows is None:
            new = self.compute(missing.to_pylist())
            base = rows.num_rows if rows is not None else 0
            where[~known] = base + np.arange(len(missing))
            rows = new if rows is None else pa.concat_tables([rows, new])
            rows = rows.combine_chunks()
            self._keep(missing, rows)
        return rows.take(pa.array(where))

    def _keep(self, missing: pa.Array, rows: pa.Table) -> None:
        self.units = pa.concat_arrays([self.units, missing])
        self.met = np.append(self.met, np.ones(len(missing), np.float32))
        self.rows = rows
        if len(self.units) > self.most:
            best = np.sort(np.argpartition(-self.met, self.most // 2)[: self.most // 2])
            at = pa.array(best)
            self.units, self.rows, self.met = self.units.take(at), rows.take(at).combine_chunks(), self.met[best] / 2

    def spread(self, lists: pa.ListArray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows of the distinct units in ``lists``; for each unit in order its row; where the units of each list begin, and the end."""
        flat = lists.flatten().dictionary_encode()
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        return self.of(flat.dictionary), flat.indices.to_numpy(zero_copy_only=False), ends


def lists(values: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int32, len(values)), out=ends[1:])
    flat = np.fromiter(chain.from_iterable(values), kind.to_pandas_dtype(), int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def joined(rows: pa.Array, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows[at]`` in a row, and where those of each text begin, and the end."""
    picked = rows.take(pa.array(at))
    sizes = picked.value_lengths().to_numpy(zero_copy_only=False)
    totals = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return picked.flatten().to_numpy(zero_copy_only=False), totals[ends]


#: Units of letters only: the tokenizers' patterns keep them in one part, so the model can have them without the steps before it.
_LETTERS = re.compile(f"{_LATIN}+")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes of UTF-8: printable ones as themselves, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library, unit by unit."""

    _of: dict[tuple, Encoder] = {}

    def __init__(self, path: str, plain: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = pa.uint16() if self.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        self.model, self.bytes = self.tokenizer.model, byte_letters()
        self.model._resize_cache(0)  # the memory below is the cache
        self.folded = self.model.end_of_word_suffix is not None  # lower case, words without their spaces
        self.memory = Memory(self._compute)

    @classmethod
    def at(cls, name: str, path: str | None = None, plain: bool = False) -> Encoder:
        """One for each file and worker process, with its memory. ``plain`` reads special tokens' strings as text."""
        path = cls.place(name, path)[0]
        if (path, plain) not in cls._of:
            cls._of[path, plain] = cls(path, plain)
        return cls._of[path, plain]

    @staticmethod
    def place(name: str, path: str | None) -> tuple[str]:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        return (path,)

    def ids(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        rest: list[int] = []
        word, tokenize, letters = _LETTERS.fullmatch, self.model.tokenize, self.bytes
        space = "" if self.folded else letters[32]
        for i, unit in enumerate(units):
            begin = unit[:1] == " "
            if word(unit, begin):
                text = unit[begin:].lower() if self.folded else unit[begin:]
                text = text if text.isascii() else text.encode().decode("latin-1").translate(letters)
                out.append([t.id for t in tokenize(space + text if begin else text)])
            else:
                rest.append(i)
                out.append([])
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([units[i] for i in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _compute(self, units: list[str]) -> pa.Table:
        return pa.table({"ids": lists(self.ids(units), self.kind)})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin, and the end."""
        rows, at, ends = self.memory.spread((folded_words if self.folded else cut)(texts, whole=self.special))
        return joined(column(rows, "ids"), at, ends)
