"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation is the one with the highest sum of piece scores. Scores are kept for a window as long as the
longest piece; back pointers are followed from every position in it, and as soon as all
of them meet at one boundary the ids before it are final and are handed out. Pieces never go beyond certain places, such as a space that follows
another character: all paths meet there. What stands between two of them is streamed once and remembered.

A text may hold the mark that pieces have for a space. It is spelled in bytes, as is a space alone if that has no piece, so that decoding
tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenframe.llm import units
from burdenframe.llm.common import ROWS_AT_A_TIME, only

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for that character itself where it is in a text; no text can hold it.
HELD = "\udc81"
CHUNK_CHARS = 4_000_000
#: Penalty of a byte piece below the least score of the other pieces.
UNKNOWN_PENALTY = 10
#: Below this a score marks pieces that are kept for decoding only.
NEVER = -1e8


class Codec:
    _of: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.scores = {p: (model.get_score(i), i) for i, p in enumerate(self.pieces)
                       if i not in self.silent and i not in self.byte_of and model.get_score(i) > NEVER}
        # every beginning of a piece, with score and id where it is a piece itself
        self.begun = {p[:n]: () for p in self.scores for n in range(1, len(p))} | self.scores
        self.longest = max(map(len, self.scores))
        self.byte_score = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        spelled = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode()
                   for i, p in enumerate(self.pieces)]
        self.spelled = pa.array(spelled, pa.binary())
        self.cuts = units.PieceCuts(list(self.scores), SPACE)
        self.memory = units.Memory(self._compute)

    @classmethod
    def at(cls, path: str | None) -> Codec:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in lists that are final when they come.

        Of segmentations with equal sums the one whose last piece is longest wins, at every position.
        """
        begun, longest, end = self.begun.get, self.longest, len(text)
        best, back, piece = {0: 0}, {}, {}  # by position; ``best`` only for the window ahead
        done = 0
        for i in range(end):
            base, c = best.pop(i), text[i]
            if c not in self.scores:
                data = (SPACE if c == HELD else " " if c == SPACE else c).encode("utf-8", "surrogatepass")
                s = base + self.byte_score * len(data)
                if i + 1 not in best or s > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = s, i, data
            for j in range(i + 1, min(i + longest, end) + 1):
                found = begun(text[i:j])
                if found is None:
                    break
                if found:
                    s = base + found[0]
                    if j not in best or s > best[j]:
                        best[j], back[j], piece[j] = s, i, found[1]
            if i - done >= 2 * longest and (i - done) % longest == 0:
                meet = self._meeting(back, list(best), done)
                if meet > done:
                    yield self._path(back, piece, done, meet)
                    for k in range(done, meet + 1):
                        back.pop(k, None), piece.pop(k, None)
                    done = meet
        if end > done:
            yield self._path(back, piece, done, end)

    @staticmethod
    def _meeting(back: dict[int, int], starts: list[int], done: int) -> int:
        """The last boundary that the paths to all ``starts`` share."""
        front = set(starts)
        while len(front) > 1:
            last = max(front)
            front.discard(last)
            front.add(back[last] if last > done else done)
        return front.pop()

    def _path(self, back, piece, begin: int, end: int) -> list[int]:
        out, at = [], end
        while at > begin:
            p = piece[at]
            if isinstance(p, int):
                out.append(p)
            else:
                out.extend(self.bytes[b] for b in reversed(p))
            at = back[at]
        return out[::-1]

    def _compute(self, parts: list[str]) -> pa.Table:
        written = (u.replace(SPACE, HELD).replace(" ", SPACE) for u in parts)
        return pa.table({"ids": units.lists([[i for ids in self.stream(u) for i in ids] for u in written], pa.int32())})

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts; none for empty ones."""
        rows, at, ends = self.memory.spread(self.cuts(units.spaced(texts)))
        ids, ends = units.joined(units.column(rows, "ids"), at, ends)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: bytes are joined to characters, the space that encoding puts in front goes. Null for null."""
        sizes = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        spelled = pc.binary_join(pa.ListArray.from_arrays(ends, self.spelled.take(ids.flatten())), b"")
        try:
            texts = spelled.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that make no characters
            texts = pa.array([b.decode("utf-8", "replace") for b in spelled.to_pylist()], pa.string())
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``ids`` of every row. Null and empty texts have no ids; repeated rows are encoded alike;
    an empty table gives an empty table; other columns are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(model)
        for table in units.chunks(rows, most=CHUNK_CHARS):
            ids = codec.encode(units.texts_of(table))
            yield pa.RecordBatch.from_arrays([units.column(table, "doc_id"), units.column(table, "text"), ids], schema=schema)

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoder(model: str | None = None):
    """A function from a column of ids to the text. Null ids give null, no ids an empty text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        codec = Codec.at(model)
        parts = [codec.decode(ids.slice(at, ROWS_AT_A_TIME)) for at in range(0, len(ids), ROWS_AT_A_TIME)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode
