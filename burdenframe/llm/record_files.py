"""Token ids in files of length-delimited records, with a separate offset index for reads in any order.

A record is one document::

    uint64 length | uint32 masked CRC-32C of these 8 bytes | payload of that length | uint32 masked CRC-32C of the payload

and its payload ``uint8 1 if the document has an id | uint8 bytes per token id | int64 document id | token ids``; all numbers are
little-endian. A masked checksum is the checksum rotated right by 15 bits plus 0xA282EAD8, so that a checksum over data that holds
checksums stays sound. Beside each data file lies its index: for every record, and for the end, its offset in the file and how many
token ids precede it there (two uint64), then a masked CRC-32C of it all. Whoever wants a record reads two entries and one range.

Tasks write files under names of their own attempt and return one manifest row per file. The manifest is a table that Spark commits,
so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burdenframe.llm import units
from burdenframe.plans.workspace import stored, work_folder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: A task goes on to the next file once one has so many bytes; a reading task gets records of about so many.
FILE_BYTES, READ_BYTES = 128_000_000, 32_000_000
HEAD, PAYLOAD, FOOT = "<QI", "<BBq", "<I"
HEAD_SIZE, PAYLOAD_SIZE, FOOT_SIZE = map(struct.calcsize, (HEAD, PAYLOAD, FOOT))
MANIFEST = "file string, part int, turn int, records long, ids long, bytes long"

# Fixed values of the Castagnoli checksum and its mask.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_BLOCK = 256


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to a checksum, by the number of bytes after it; and what 256 zero bytes make of each byte of a checksum."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
    adds = np.empty((_BLOCK, 256), np.uint32)
    adds[0] = first
    for k in range(1, _BLOCK):
        adds[k] = (adds[k - 1] >> 8) ^ first[adds[k - 1] & 255]
    moved = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(_BLOCK):
        moved = (moved >> 8) ^ first[moved & 255]
    return adds, moved


def crc32c(data: bytes | np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each range of ``data``, all ranges at once.

    The checksum is linear: every range is cut into blocks of 256 bytes from its end, a block's checksum is the exclusive-or of
    what its bytes add, and blocks are joined from left to right.
    """
    data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    adds, moved = _tables()
    sizes = (ends - begins).astype(np.int64)
    blocks = -(-sizes // _BLOCK)
    last = np.cumsum(blocks)
    crc = np.zeros(len(sizes), np.uint32)
    by_place = adds[::-1].ravel()
    place = (np.arange(_BLOCK, dtype=np.int32) * 256)[None, :]
    lo = 0
    while lo < len(sizes):  # some ranges at a time, about 4 MB
        hi = max(lo + 1, int(np.searchsorted(last, (last[lo - 1] if lo else 0) + 16_384, "right")))
        count, base = blocks[lo:hi], (last[lo - 1] if lo else 0)
        rows = np.zeros((int(count.sum()), _BLOCK), np.uint8)
        flat = rows.reshape(-1)
        for i in range(lo, hi):
            end = (int(last[i]) - int(base)) * _BLOCK
            part = flat[end - int(sizes[i]) : end]
            part[:] = data[begins[i] : ends[i]]
            part[:4] ^= 0xFF  # the checksum's initial value
        own = np.empty(len(rows), np.uint32)
        for k in range(0, len(rows), 2048):
            own[k : k + 2048] = np.bitwise_xor.reduce(by_place[place + rows[k : k + 2048]], axis=1)
        order = np.argsort(-count, kind="stable")
        first, many = (last[lo:hi] - count - base)[order], count[order]
        state = np.zeros(hi - lo, np.uint32)
        for k in range(int(many[0]) if len(many) else 0):
            n = int(np.searchsorted(-many, -k, "left"))  # ranges with more than k blocks
            s = state[:n]
            state[:n] = moved[0][s & 255] ^ moved[1][s >> 8 & 255] ^ moved[2][s >> 16 & 255] ^ moved[3][s >> 24] ^ own[first[:n] + k]
        crc[lo:hi][order] = state
        lo = hi
    short = sizes < 4
    for i in np.flatnonzero(short):
        crc[i] = _short(data[begins[i] : ends[i]].tobytes())
    return np.where(short, crc, ~crc)


def _short(data: bytes) -> int:
    table, c = _tables()[0][0], 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ int(table[(c ^ b) & 255])
    return c ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return (((c >> np.uint64(15) | c << np.uint64(17)) & np.uint64(0xFFFFFFFF)) + np.uint64(MASK_DELTA) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Payloads as records."""
    lengths = np.array([len(p) for p in payloads], "<u8")
    ends = np.cumsum(lengths.astype(np.int64))
    of_data = masked(crc32c(b"".join(payloads), ends - lengths.astype(np.int64), ends)).tolist()
    at = 8 * np.arange(len(payloads) + 1)
    of_length = masked(crc32c(lengths.tobytes(), at[:-1], at[1:])).tolist()
    return [struct.pack(HEAD, len(p), a) + p + struct.pack(FOOT, b) for p, a, b in zip(payloads, of_length, of_data)]


def opened(data: bytes, offsets: np.ndarray) -> list[memoryview]:
    """Payloads of the records at ``offsets``, which end with the end of the last; raises if a length or checksum is wrong."""
    view, begins, ends = memoryview(data), offsets[:-1], offsets[1:]
    held = np.array([struct.unpack_from(HEAD, data, b) for b in begins.tolist()], np.uint64).reshape(-1, 2)
    right = held[:, 0].astype(np.int64) + HEAD_SIZE + FOOT_SIZE == ends - begins
    right &= masked(crc32c(data, begins, begins + 8)) == held[:, 1]
    feet = np.array([struct.unpack_from(FOOT, data, e - FOOT_SIZE)[0] for e in ends.tolist()], np.uint32)
    right &= masked(crc32c(data, begins + HEAD_SIZE, ends - FOOT_SIZE)) == feet
    if not right.all():
        raise ValueError(f"{int((~right).sum())} damaged records, the first at offset {int(begins[np.argmin(right)])}")
    return [view[b + HEAD_SIZE : e - FOOT_SIZE] for b, e in zip(begins.tolist(), ends.tolist())]


def index_bytes(offsets: list[int], ids_before: list[int]) -> bytes:
    body = np.column_stack([offsets, ids_before]).astype("<u8").tobytes()
    return body + struct.pack(FOOT, int(masked(crc32c(body, np.array([0]), np.array([len(body)])))[0]))


def index_entries(data: bytes) -> np.ndarray:
    """Rows of (offset, ids before), one more than records."""
    body = data[: -FOOT_SIZE]
    if len(body) % 16 or int(masked(crc32c(body, np.array([0]), np.array([len(body)])))[0]) != struct.unpack(FOOT, data[-FOOT_SIZE :])[0]:
        raise ValueError("damaged index")
    return np.frombuffer(body, "<u8").reshape(-1, 2).astype(np.int64)


class _Writer:
    """The data files and indexes of one task, one after the other."""

    def __init__(self, folder: str, most: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.most, self.turn, self.out, self.rows = most, 0, None, []
        context = TaskContext.get()
        self.part, self.attempt = context.partitionId(), context.taskAttemptId()

    def add(self, records: list[bytes], sizes: list[int]) -> None:
        for record, n in zip(records, sizes):
            if self.out is None:
                self.name = f"part-{self.part:06d}-{self.turn:04d}-{self.attempt}"
                self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.records", buffer_size=1 << 20)
                self.offsets, self.before = [0], [0]
            self.out.write(record)
            self.offsets.append(self.offsets[-1] + len(record))
            self.before.append(self.before[-1] + n)
            if self.offsets[-1] >= self.most:
                self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.index") as f:
            f.write(index_bytes(self.offsets, self.before))
        self.rows.append((self.name, self.part, self.turn, len(self.offsets) - 1, self.before[-1], self.offsets[-1]))
        self.out, self.turn = None, self.turn + 1


def write(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, tokenizer: str | None = None,
          file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Encode all texts, append id 0 to each and write them in ascending doc_id order; the manifest, and the folder.

    Files follow each other by (part, turn). Rows with a null doc_id come first; rows with one doc_id are ordered by their text's hash
    and text, so that they may lie in several parts. A null or empty text is the single id 0; a text of any length is one record;
    repeated rows are records of their own; an empty table gives an empty manifest. Other columns are left out, whatever their names.
    ``folder`` is in a file system that Arrow reaches too (file, hdfs, s3, gs, abfs); without it, it is in the shared folder of the session.
    """
    folder = folder or work_folder(docs.sparkSession, "records")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = units.Encoder.at(TOKENIZER, tokenizer), _Writer(folder, file_bytes)
        kind = np.dtype("<u2" if encoder.kind == pa.uint16() else "<u4")
        end = np.array([END_ID], kind).tobytes()
        for table in units.chunks(batches):
            ids, at = encoder.encode(units.texts_of(table))
            data, at, payloads = memoryview(ids.astype(kind, copy=False).tobytes()), at.tolist(), []
            for key, lo, hi in zip(units.column(table, "doc_id").to_pylist(), at, at[1:]):
                head = struct.pack(PAYLOAD, key is not None, kind.itemsize, key or 0)
                payloads.append(b"".join((head, data[lo * kind.itemsize : hi * kind.itemsize], end)))
            writer.add(frames(payloads), [hi - lo + 1 for lo, hi in zip(at, at[1:])])
        writer.close()
        if writer.rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "turn", "records", "ids", "bytes"), r)) for r in writer.rows], _MANIFEST)

    return stored(rows.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest"), folder


_MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int32()), ("turn", pa.int32()), ("records", pa.int64()), ("ids", pa.int64()),
                       ("bytes", pa.int64())])


def _ranges(manifest: DataFrame, read_bytes: int) -> DataFrame:
    """Stretches of records of about ``read_bytes``, and how many ids precede their file. The window has a row per file."""
    before = F.sum("ids").over(Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1))
    step = F.greatest(F.lit(1), F.floor(F.col("records") * F.lit(read_bytes) / F.col("bytes"))).cast("long")
    files = manifest.select("file", "records", F.coalesce(before, F.lit(0)).alias("start"), step.alias("step"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.col("step"))).alias("first")
    return files.select("file", "start", "records", "step", first).select(
        "file", "start", "first", F.least(F.col("first") + F.col("step"), F.col("records")).alias("last"))


def read(manifest: DataFrame, folder: str, seed: int | None = None, with_ids: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """Records read back and checked: doc_id, ``start`` (ids of all records before it), ``n_tokens`` and ``ids_crc32`` of the ids as
    little-endian unsigned 32-bit numbers, and with ``with_ids`` the ids.

    Without a seed, tasks read stretches of files. With a seed, the records come in an order drawn by it, each found by its index entry. A
    damaged record or index raises an error. An empty manifest gives an empty table.
    """
    ranges = _ranges(manifest, read_bytes)
    tasks = int(manifest.agg(F.sum(F.ceil(F.col("bytes") / read_bytes))).first()[0] or 1)
    if seed is None:
        ranges = ranges.repartition(tasks)
    else:
        ranges = ranges.select("file", "start", F.explode(F.sequence("first", F.col("last") - 1)).alias("first"))
        ranges = ranges.withColumn("last", F.col("first") + 1).withColumn("drawn", F.xxhash64(F.lit(seed), "file", "first"))
        ranges = ranges.repartitionByRange(tasks, "drawn").sortWithinPartitions("drawn").drop("drawn")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        entries: dict[str, np.ndarray] = {}

        def record_rows(file: str, start: int, first: int, last: int) -> list[tuple]:
            if file not in entries:
                if len(entries) > 64:
                    entries.clear()
                with fs.open_input_file(f"{top}/{file}.index") as f:
                    entries[file] = index_entries(f.read())
            own, out = entries[file][first : last + 1], []
            with fs.open_input_file(f"{top}/{file}.records") as f:
                data = f.read_at(int(own[-1, 0] - own[0, 0]), int(own[0, 0]))
            for payload, before, after in zip(opened(data, own[:, 0] - own[0, 0]), own[:, 1].tolist(), own[1:, 1].tolist()):
                named, width, key = struct.unpack_from(PAYLOAD, payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=PAYLOAD_SIZE)
                if len(ids) != after - before:
                    raise ValueError(f"the index of {file} disagrees with its records")
                row = (key if named else None, start + before, len(ids), zlib.crc32(ids.astype("<u4")))
                out.append((*row, ids.astype(np.int32)) if with_ids else row)
            return out

        for batch in batches:
            for file, start, first, last in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "first", "last"))):
                rows = record_rows(file, start, first, last)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return ranges.mapInArrow(run, names + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the records of all documents and read them back, without the ids."""
    manifest, folder = write(docs, doc_id, text, tokenizer=tokenizer)
    return read(manifest, folder, with_ids=False)
