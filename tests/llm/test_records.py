"""Record files against a plain reading of the format."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from burdenframe.llm import record_files as R

AWKWARD = ["two words, one.Two", None, "", "  leading\n\n\nand  runs \n", "a" * 3000, "word " * 5000, "<|endoftext|>", "\n\n<|endoftext|> x",
           "naïve é日本 \x85　\x1c end", "same", "same", " ", "\n", "x.,y., z"]


def crc32c_by_bits(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def mask(c: int) -> int:
    return ((c >> 15 | c << 17) & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))


def expected(tokenizer, rows):
    out, start = [], 0
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_checksum():
    assert crc32c_by_bits(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 4, 8, 255, 256, 257, 511, 512, 5000, 70_000, 9]
    data = rng.integers(0, 256, sum(sizes), np.uint8).tobytes()
    ends = np.cumsum(sizes)
    found = R.crc32c(data, ends - np.array(sizes), ends)
    assert [int(x) for x in found] == [crc32c_by_bits(data[e - n : e]) for e, n in zip(ends, sizes)]


def test_written_files_and_reads(spark, documents, tokenizer, tmp_path):
    docs = documents(*[(3 * i - 7, t) for i, t in enumerate(AWKWARD)])
    manifest, folder = R.write(docs.repartition(5), folder=str(tmp_path / "out"), file_bytes=60)
    want = expected(tokenizer, [(3 * i - 7, t) for i, t in enumerate(AWKWARD)])
    names = [r.file for r in manifest.orderBy("part", "turn").collect()]
    assert len(names) > 2
    plain = []
    for name in names:
        data, at = Path(folder, f"{name}.records").read_bytes(), 0
        index = Path(folder, f"{name}.index").read_bytes()
        offsets = []
        while at < len(data):
            offsets.append(at)
            n, check = struct.unpack_from("<QI", data, at)
            assert check == mask(crc32c_by_bits(data[at : at + 8]))
            payload = data[at + 12 : at + 12 + n]
            assert struct.unpack_from("<I", data, at + 12 + n)[0] == mask(crc32c_by_bits(payload))
            named, width, key = struct.unpack_from("<BBq", payload)
            plain.append((key if named else None, np.frombuffer(payload, f"<u{width}", offset=10).tolist()))
            at += 16 + n
        assert [o for o, _ in struct.iter_unpack("<QQ", index[:-4])] == [*offsets, len(data)]
    assert plain == [(k, ids) for k, _, _, _, ids in want]
    for seed in (None, 1, 2):
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in R.read(manifest, folder, seed=seed, read_bytes=2000).collect()]
        assert sorted(got) == sorted(want)
    orders = [[r.doc_id for r in R.read(manifest, folder, seed=s, with_ids=False).collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]


def test_nulls_ties_and_extra_columns(spark, tokenizer):
    rows = [(None, "b"), (None, "a"), (5, "x"), (5, "y"), (5, "x"), (1, None)]
    docs = spark.createDataFrame([(k, t, 1, "f") for k, t in rows], "doc_id long, text string, h int, file string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in R.round_trip(docs).collect())
    assert [(k, n) for _, k, n in got] == [(None, 2), (None, 2), (1, 1), (5, 2), (5, 2), (5, 2)]
    assert [s for s, _, _ in got] == [0, 2, 4, 5, 7, 9]


def test_empty_table(documents):
    assert R.round_trip(documents()).collect() == []


def test_damage_is_found(documents, tmp_path):
    manifest, folder = R.write(documents("some text here", "more"), folder=str(tmp_path / "out"))
    path = next(Path(folder).glob("*.records"))
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged records"):
        R.read(manifest, folder).collect()
