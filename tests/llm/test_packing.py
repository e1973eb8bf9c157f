from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burdenframe.llm import packing, units


def bins_of(histogram, capacity):
    """Sequences that a plan makes: number to its pieces as (offset, length)."""
    steps, out = packing.plan(histogram, capacity), {}
    for length, n in histogram.items():
        own = [s[1:] for s in steps if s[0] == length]
        for r in range(n):
            rank, first, each, offset = max(s for s in own if s[0] <= r)
            out.setdefault(first + (r - rank) // each, []).append((offset + length * ((r - rank) % each), length))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_gapless_and_close_to_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 2048])
    histogram = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), min(capacity, 25))}
    found = bins_of(histogram, capacity)
    for pieces in found.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2
    descending = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        gap = min((g for g in descending if g >= length), default=None)
        if gap is None:
            descending.append(capacity - length)
        else:
            descending[descending.index(gap)] -= length
    assert len(found) <= len(descending) * 1.05 + 1


def test_plan_needs_lengths_within_the_capacity():
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


PARTS = ["a", "B", " ", " ", "\n", "\n\n", "  ", "\t", "\r", ".", ",", "'s", "1", "²", "é", "É", "e\u0301", "\u0301", "Σ", "Ünter", "word", "日", "\x85", "　", "\x1c", "-",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\ue000", "ﬁ", "İ"]


@pytest.mark.parametrize("name, plain", [(packing.TOKENIZER, False), ("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_those_of_the_whole_text(name, plain):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = plain
    rng = random.Random(2)
    texts = ["Don't  stop\n\nit's 10\t000 Ǆ é́ <|endoftext|>x<|startoftext|> ﬁ", "\x1c\x85\xa0 a　b 日本", "", "ΣΑΣ ΟΔΟΣ.", "x" * 5000]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(20_000)]
    ids, ends = units.Encoder.at(name, plain=plain).encode(pa.array(texts))
    found = [ids[lo:hi].tolist() for lo, hi in zip(ends, ends[1:])]
    wrong = [t for t, own, e in zip(texts, found, tokenizer.encode_batch(texts, add_special_tokens=False)) if own != e.ids]
    assert wrong == []


def test_memory_keeps_what_is_met_often():
    asked = []
    memory = units.Memory(lambda new: (asked.extend(new), pa.table({"n": [len(u) for u in new]}))[1], most=4)
    for group in (["a", "bb"], ["a", "ccc"], ["a", "dddd", "e"], ["f", "g", "a"], ["a", "h"]):
        assert memory.of(pa.array(group)).column("n").to_pylist() == [len(u) for u in group]
        assert len(memory.units) <= 4
    assert asked.count("a") == 1


def test_chunks_keep_all_rows():
    texts = ["x" * n for n in (0, 5, 100, 3, 3, 3, 50, 0, 7)] + [None]
    batches = pa.table({"text": texts}).to_batches(4)
    for most in (1, 8, 10_000):
        found = list(units.chunks(iter(batches), most=most))
        assert [t for c in found for t in c.column("text").to_pylist()] == texts
        assert all(c.num_rows == 1 or sum(len(t or "") for t in c.column("text").to_pylist()) <= most for c in found)
    assert list(units.chunks(iter([]))) == []


def test_pack_and_sequences(spark, documents):
    texts = [None, "", "word " * 5000, "a", "a", *["some more words here " * k for k in range(1, 60)]]
    docs = documents(*texts).union(documents((3, "a"))).withColumn("piece", F.lit("clash"))
    packed = packing.pack(docs, with_ids=True)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert 1 <= r.length <= packing.CAPACITY and r.start == r.piece * packing.CAPACITY
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        whole.setdefault((r.doc_id, r.piece), []).append(list(r.ids))
    assert len(whole[3, 0]) == 2
    for i, text in enumerate(texts):
        parts = [whole[i, k][0] for k in range(len([1 for d, _ in whole if d == i]))]
        assert sum(parts, []) == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    made = packing.sequences(packed).collect()
    assert sum(len(s.ids) for s in made) == sum(r.length for r in rows)
    assert max(len(s.ids) for s in made) <= packing.CAPACITY


def test_no_rows(documents):
    assert packing.pack(documents()).collect() == []
