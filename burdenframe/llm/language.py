"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every other character counts as a space, and the one- to three-letter sequences that hold a
letter are hashed into a fixed number of buckets. Learning sums bucket counts per language over all labelled texts;
the log-probability matrix (buckets x languages) is broadcast, and texts are scored in batches with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.llm.common import ROWS_AT_A_TIME, batches, only, record_batch, slices

BITS = 16
BUCKETS = 1 << BITS
#: Bounds the matrix: 256 languages are 128 MB.
MAX_LANGUAGES = 256
SMOOTHING = 0.1
UNKNOWN = "und"
#: Multipliers of the hash.
FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the sequences that start at each character, by length (``BUCKETS`` where there is no letter);
    where each text begins; whether it has a letter. Two spaces stand before each text, so texts don't mix."""
    low = [(t or "").lower() for t in texts]
    begins = np.cumsum([0] + [len(t) + 2 for t in low[:-1]])
    codes = np.frombuffer(("  " + "  ".join(low) + "  ").encode("utf-32-le"), "<u4")
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(32))
    n = len(c) - 2
    h, held, out = np.zeros(n, np.uint32), np.zeros(n, bool), []
    for k, factor in enumerate(FACTORS):
        h = (h ^ c[k : k + n]) * factor
        held |= letter[k : k + n]
        out.append(np.where(held, (h ^ (h >> np.uint32(15))) * FACTORS[2 - k] >> np.uint32(32 - BITS), np.uint32(BUCKETS)))
    return out, begins, np.logical_or.reduceat(letter[:n], begins)


@dataclass
class Model:
    """``weights``: log-probabilities, one row per language and column per bucket, the last column zeros; ``prior``: log share of the rows;
    ``usual``: each language's mean log-probability over what was learned."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    usual: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their probabilities, and their ``fit``: the mean log-probability of a text's sequences, less what is usual in the language. The
        probability only compares the languages learned and goes to 1 with the length; the fit doesn't."""
        names, score, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return names, score, fit
        for lo, hi in batches(texts, 200_000):
            buckets, begins, lettered = grams(texts[lo:hi])
            at = [b.astype(np.intp) for b in buckets]
            sums = np.stack([np.add.reduceat(sum(np.take(w, b) for b in at), begins) for w in self.weights], 1) + self.prior
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            score[lo:hi] = np.where(lettered, share, 0.0)
            held = np.add.reduceat(sum((b != BUCKETS).astype(np.int64) for b in at), begins)
            mean = (np.take_along_axis(sums, best[:, None], 1)[:, 0] - self.prior[best]) / np.maximum(held, 1)
            fit[lo:hi] = np.where(lettered, mean - self.usual[best], 0.0)
            names[lo:hi] = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, score, fit


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = SMOOTHING) -> Model:
    """Learn from every row whose text and language are not null. Raises beyond ``MAX_LANGUAGES``; a model that has
    learnt from no row takes every text for ``und``. Texts may be of any length, repeated rows count as often as they occur, and other columns are
    left out, whatever their names.

    Only counts leave the tasks: at most one row per language and bucket, added up before they are shuffled.
    """
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(rows):
            texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in batches(texts):
                buckets, begins, _ = grams(texts[lo:hi])
                kinds, label = np.unique(np.array(names[lo:hi], object), return_inverse=True)
                at = np.repeat(label, np.diff(np.append(begins, len(buckets[0])))) * (BUCKETS + 1)
                found = sum(np.bincount(at + b, minlength=len(kinds) * (BUCKETS + 1)) for b in buckets).reshape(len(kinds), -1)
                found[:, BUCKETS] = np.bincount(label, minlength=len(kinds))  # the last column counts texts
                for kind, row in zip(kinds, found):
                    counts[kind] = counts[kind] + row if kind in counts else row
            if len(counts) > MAX_LANGUAGES:
                yield from emit(counts)
                counts = {}
        yield from emit(counts)

    def emit(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, row in counts.items():
            at = np.flatnonzero(row)
            yield record_batch(schema, [kind] * len(at), at.astype(np.int32), row[at])

    rows = only(docs, text=text, lang=lang).dropna()
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((0, BUCKETS + 1)), np.zeros(0), np.zeros(0))
    counts = rows.mapInArrow(sums, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toArrow()  # a row per language
    table = np.zeros((BUCKETS + 1, len(languages)))
    for name, own in zip(found.column("lang").to_pylist(), found.column("counts")):
        bucket, n = own.values.flatten()
        table[bucket.to_numpy(), languages.index(name)] = n.to_numpy()
    prior = np.log(table[BUCKETS] / table[BUCKETS].sum())
    weights = np.log(table[:BUCKETS] + smoothing) - np.log(table[:BUCKETS].sum(0) + smoothing * BUCKETS)
    usual = (table[:BUCKETS] * weights).sum(0) / np.maximum(table[:BUCKETS].sum(0), 1)
    return Model(languages, np.ascontiguousarray(np.vstack([weights, np.zeros(len(languages))]).T), prior, usual)


def predictor(spark: SparkSession, model: Model):
    """A function from a text column to a struct of ``lang``, ``score``, the probability from 0 to 1, and ``fit`` as in ``Model.judge``.

    A null text, or one without letters, is ``und`` with score 0. Rows are scored one by one, so repeated rows get equal
    results, and ties go to the language first in the alphabet.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, fit double")
    def predict(text: pa.Array) -> pa.Array:
        found = [shared.value.judge(text.slice(at, ROWS_AT_A_TIME).to_pylist()) for at in range(0, len(text), ROWS_AT_A_TIME)]
        columns = ([x for part in found for x in part[k]] for k in range(3))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()))], ["lang", "score", "fit"])

    return predict


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning, by the CRC-32 of its key as text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
