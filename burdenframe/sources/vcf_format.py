"""``spark.read.format("vcf")``: VCF text as a data source.

Files are listed once on the driver and dealt into partitions by size: small files share one, large plain files are read in ranges, compressed
ones whole. A partition takes the sample names from the header of each file that it reads, so names need no second scan and no join. A row is
a site and a block of samples, which bounds its length in cohorts of any size. The lines of many small files, or of a part of a large one, are taken
apart together, as Arrow columns.

Options: ``path`` or ``paths`` (what ``load`` was given), ``pathGlobFilter`` (with ``{a,b}`` alternatives), ``recursive`` (true), ``intervals``
(``contig`` or ``contig:start-end``, end excluded, separated by commas), ``partitionBytes``, ``minPartitions``, ``samplesPerRow``. Lines outside the intervals are
dropped before they are split into cells. With ``pushFilters``, and ``spark.sql.python.filterPushdown.enabled`` in the session, filters on
``contig`` and ``pos`` are used in the same way. Files lie where Arrow reaches them (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

FORMAT = "vcf"
#: Opening a file counts as reading so many bytes.
OPEN_BYTES = 100_000
PARTITION_BYTES, SAMPLES_PER_ROW = 64_000_000, 1024
READ_BYTES, BATCH_CELLS = 4_000_000, 200_000
FIXED_COLUMNS = 9  # CHROM POS ID REF ALT QUAL FILTER INFO FORMAT
SITE_FIELDS = ("id", "ref", "alt", "qual", "filter", "info", "format")
SCHEMA = ("file string, file_name string, contig string, pos int, id string, ref string, alt string, qual string, filter string, info string, "
          "format string, block int, sample_names array<string>, cells array<string>")
_ARROW = pa.schema([("file", pa.string()), ("file_name", pa.string()), ("contig", pa.string()), ("pos", pa.int32()),
                    *[(f, pa.string()) for f in SITE_FIELDS], ("block", pa.int32()), ("sample_names", pa.list_(pa.string())),
                    ("cells", pa.list_(pa.string()))])


def plain_contig(name: str) -> str:
    """``chr1..chr22, chrX, chrY`` lose their prefix and ``chrM`` becomes ``MT``; other names stay."""
    if name == "chrM":
        return "MT"
    return name[3:] if re.fullmatch(r"chr([1-9]|1\d|2[0-2]|X|Y)", name) else name


@dataclass
class Stretch:
    """Bytes of a file; ``end`` is None for a compressed one."""

    path: str
    begin: int
    end: int | None


@dataclass
class Stretches(InputPartition):
    parts: list[Stretch]


@dataclass
class Limits:
    """Positions asked for: by contig, ranges with both ends included; None for all contigs."""

    ranges: dict[str, list[tuple[int, int]]] | None = None

    @classmethod
    def of(cls, text: str | None) -> Limits:
        if not text:
            return cls()
        found: dict[str, list[tuple[int, int]]] = {}
        for part in text.split(","):
            contig, _, span = part.strip().partition(":")
            low, _, high = span.replace("_", "").partition("-")
            found.setdefault(plain_contig(contig), []).append((int(low), int(high) - 1) if span else (-1 << 31, 1 << 31))
        return cls(found)

    def hold(self, contig: str, pos: int | None) -> bool:
        if self.ranges is None:
            return True
        own = self.ranges.get(contig, ())
        return any(low <= pos <= high for low, high in own) if pos is not None else bool(own)


def _names(pattern: str) -> list[str]:
    """Patterns without braces that together mean ``pattern``."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [p for x in m[1].split(",") for p in _names(pattern[: m.start()] + x + pattern[m.end() :])] if m else [pattern]


def located(path: str, roots: dict[str, tuple[pafs.FileSystem, str]]) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it and what stands before that path in the address. ``roots`` keeps the file systems that were met."""
    path = re.sub(r"^file:/+", "/", path)
    root = "/".join(path.split("/", 3)[:3]) if "://" in path else ""
    if root in roots and path.startswith(roots[root][1]):
        fs, prefix = roots[root]
        return fs, path[len(prefix) :] if root else os.path.abspath(path), prefix
    if not root:
        roots[root] = pafs.LocalFileSystem(), ""
        return roots[root][0], os.path.abspath(path), ""
    fs, top = pafs.FileSystem.from_uri(path)
    prefix = path[: path.index(top)]
    if path == prefix + top:
        roots[root] = fs, prefix
    return fs, top, prefix


def blocks_of(fs: pafs.FileSystem, part: Stretch) -> Iterator[bytes]:
    """Texts of whole lines that begin in a stretch."""
    begin, end = (0, 1 << 62) if part.end is None else (part.begin, part.end)
    with fs.open_input_stream(part.path, compression="gzip") if part.end is None else fs.open_input_file(part.path) as f:
        at, rest, before = max(0, begin - 1), b"", begin > 0
        if at:
            f.seek(at)
        while True:
            wanted = end - at - len(rest)
            block = f.read(min(wanted, READ_BYTES) if wanted > 0 else READ_BYTES)
            text = rest + block
            if before:  # a line that began before belongs to the stretch before
                cut = text.find(b"\n") + 1
                at += cut or len(text)
                if not block or at >= end:
                    return
                text, rest, before = (text[cut:], b"", False) if cut else (b"", b"", True)
                if before:
                    continue
            if at + (cut := text.rfind(b"\n") + 1) >= end:
                yield text[: text.index(b"\n", max(0, end - 1 - at)) + 1]
                return
            if not block:
                if text:
                    yield text
                return
            if cut:
                yield text[:cut]
            at, rest = at + cut, text[cut:]


def lines_of(fs: pafs.FileSystem, part: Stretch) -> Iterator[bytes]:
    """Lines that begin in a stretch."""
    for text in blocks_of(fs, part):
        yield from text.removesuffix(b"\n").split(b"\n")


@dataclass
class Lines:
    """Lines of a file after the same header."""

    path: str
    samples: list[str]
    lines: list[bytes]


class VcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.limits = Limits.of(self.options.get("intervals"))
        self.contigs: set[str] | None = None
        self.low, self.high = -1 << 31, 1 << 31

    def paths(self) -> list[str]:
        if "paths" in self.options:
            return json.loads(self.options["paths"])
        if "path" not in self.options:
            raise ValueError("no path to read")
        return [self.options["path"]]

    def files(self) -> list[tuple[str, int]]:
        """Full addresses and sizes. Names that begin with a dot or underscore are left out, as Spark does."""
        patterns = _names(self.options.get("pathglobfilter", "*.{vcf,vcf.gz}"))
        recursive = self.options.get("recursive", "true").lower() == "true"
        found, roots, tops = {}, {}, {}
        for path in self.paths():
            fs, top, prefix = located(path, roots)
            tops.setdefault((id(fs), prefix), (fs, []))[1].append(top)
        for (_, prefix), (fs, own) in tops.items():
            for top, info in zip(own, fs.get_file_info(own)):  # one call for all paths of a list
                if info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(prefix + top)
                for x in [info] if info.is_file else fs.get_file_info(pafs.FileSelector(top, recursive=recursive)):
                    below = "/" + x.path[len(top) :]
                    hidden = ("/." in below or "/_" in below) and any(p.startswith((".", "_")) and "=" not in p for p in below.split("/"))
                    if x.is_file and not hidden and any(fnmatchcase(x.base_name, p) for p in patterns):
                        found[prefix + x.path] = x.size
        return sorted(found.items())

    def __getstate__(self) -> dict:
        """Tasks don't need the list of all paths."""
        return {**self.__dict__, "options": _without_paths(self.options)}

    def partitions(self) -> list[Stretches]:
        files, out, held, size = self.files(), [], [], 0
        total = sum(n + OPEN_BYTES for _, n in files)
        even = max(OPEN_BYTES, total // int(self.options.get("minpartitions", 1)))
        most = min(int(self.options.get("partitionbytes", PARTITION_BYTES)), even)
        for path, n in files:
            steps = [(0, None)] if path.endswith(".gz") else [(b, min(b + most, n)) for b in range(0, n, most)]
            for begin, end in steps:
                own = OPEN_BYTES + (n if end is None else end - begin)
                if held and size + own > most:
                    out.append(Stretches(held))
                    held, size = [], 0
                held.append(Stretch(path, begin, end))
                size += own
        return out + [Stretches(held)] if held or not out else out

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for own, n in self._texts(partition):
            held.append(own)
            size += n
            if size >= READ_BYTES:
                yield from self._batches(held)
                held, size = [], 0
        yield from self._batches(held)

    def _texts(self, partition: Stretches) -> Iterator[tuple[Lines, int]]:
        """Data lines of each file with the names from the header before them, and their bytes."""
        roots: dict = {}
        for part in partition.parts:
            fs, path, _ = located(part.path, roots)
            samples = self._header(fs, path) if part.begin else []
            for text in blocks_of(fs, Stretch(path, part.begin, part.end)):
                while text.startswith(b"#") or b"\n#" in text:
                    at = 0 if text.startswith(b"#") else text.index(b"\n#") + 1
                    if at:
                        yield Lines(part.path, samples, text[: at - 1].split(b"\n")), at
                    line, _, text = text[at:].partition(b"\n")
                    if line.startswith(b"#CHROM"):
                        samples = _text(line).split("\t")[FIXED_COLUMNS:]
                if text:
                    yield Lines(part.path, samples, text.removesuffix(b"\n").split(b"\n")), len(text)

    def _batches(self, held: list[Lines]) -> Iterator[pa.RecordBatch]:
        """Rows of data lines that are asked for."""
        lines = pa.array([line for own in held for line in own.lines], pa.binary())
        source = np.repeat(np.arange(len(held)), [len(own.lines) for own in held])
        head = pc.split_pattern(lines, b"\t", max_splits=2)
        n, begin, values = _lists(head)
        keep = np.flatnonzero(n >= 2)
        if not len(keep):
            return
        n, begin, source = n[keep], begin[keep], source[keep]
        coded = values.take(pa.array(begin)).dictionary_encode()
        names, contig = [plain_contig(_text(c)) for c in coded.dictionary.to_pylist()], coded.indices.to_numpy()
        pos = _numbers(values.take(pa.array(begin + 1)))
        keep = np.flatnonzero(self._asked(names, contig, pos))
        if not len(keep):
            return
        n, begin, source, contig, pos = n[keep], begin[keep], source[keep], contig[keep], pos.take(pa.array(keep))
        rest = pc.split_pattern(_texts_of(values.take(pa.array(begin + 2, mask=n < 3))), "\t")
        n, begin, values = _lists(rest)
        fields = [values.take(pa.array(begin + k, mask=n <= k)) for k in range(len(SITE_FIELDS))]
        cells = np.maximum(n - len(SITE_FIELDS), 0)
        # a row per block of cells, the first one also without cells
        per_row = int(self.options.get("samplesperrow", SAMPLES_PER_ROW))
        blocks = np.maximum(-(-cells // per_row), 1)
        row = np.repeat(np.arange(len(n)), blocks)
        block = _counters(blocks)
        at = block * per_row
        own_cells = _ranges(values, (begin + len(SITE_FIELDS))[row] + at, np.minimum(cells[row] - at, per_row))
        samples = np.array([len(own.samples) for own in held])
        own_names = pa.array([s for own in held for s in own.samples], pa.string())
        first = (np.cumsum(samples) - samples)[source][row]
        sample_names = _ranges(own_names, first + np.minimum(at, samples[source][row]), np.clip(samples[source][row] - at, 0, per_row))
        take = pa.array(row)
        found = pa.RecordBatch.from_arrays([
            pa.array([own.path for own in held], pa.string()).take(pa.array(source[row])),
            pa.array([own.path.rsplit("/", 1)[-1] for own in held], pa.string()).take(pa.array(source[row])),
            pa.array(names, pa.string()).take(pa.array(contig[row])), pos.take(take), *[f.take(take) for f in fields],
            pa.array(block, pa.int32()), sample_names, own_cells,
        ], schema=_ARROW)
        ends = np.cumsum(np.minimum(cells[row] - at, per_row) + len(SITE_FIELDS))
        low = 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BATCH_CELLS, side="right")))
            yield found.slice(low, high - low)
            low = high

    def _asked(self, names: list[str], contig: np.ndarray, pos: pa.Array) -> np.ndarray:
        """Which sites are asked for, of contigs given as numbers of ``names``. An unknown position counts for a contig that is asked for."""
        known = pos.is_valid().to_numpy(zero_copy_only=False)
        at = pos.fill_null(0).to_numpy()
        asked = ~known | (at >= self.low) & (at <= self.high)
        if self.contigs is not None:
            asked &= np.array([c in self.contigs for c in names])[contig]
        if self.limits.ranges is not None:
            inside = np.zeros(len(asked), bool)
            for k, c in enumerate(names):
                for low, high in self.limits.ranges.get(c, ()):
                    inside |= (contig == k) & (~known | (at >= low) & (at <= high))
            asked &= inside
        return asked

    @staticmethod
    def _header(fs: pafs.FileSystem, path: str) -> list[str]:
        for line in lines_of(fs, Stretch(path, 0, 1 << 62)):
            if line.startswith(b"#CHROM"):
                return _text(line).split("\t")[FIXED_COLUMNS:]
            if not line.startswith(b"#"):
                break
        return []


def _text(line: bytes) -> str:
    return line.rstrip(b"\r").decode("utf-8", "replace")


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lengths and first places of lists in their values; a null has length 0."""
    return pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64), lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values


def _counters(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _ranges(values: pa.Array, first: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists of so many values from a place on."""
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values.take(pa.array(np.repeat(first, lengths) + _counters(lengths))))


def _number(text: bytes) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def _numbers(texts: pa.Array) -> pa.Array:
    """What Python reads as integers; null for others."""
    try:
        plain = texts.cast(pa.string())
        if pc.all(pc.match_substring_regex(plain, "^-?[0-9]{1,9}$")).as_py():
            return plain.cast(pa.int32())
    except pa.ArrowInvalid:
        pass
    return pa.array([_number(t) for t in texts.to_pylist()], pa.int32())


def _texts_of(rests: pa.Array) -> pa.Array:
    try:
        return pc.ascii_rtrim(rests.cast(pa.string()), characters="\r")
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([None if r is None else _text(r) for r in rests.to_pylist()], pa.string())


def _without_paths(options: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in options.items() if k.lower() != "paths"}


class FilteringVcfReader(VcfReader):
    """With ``pushFilters``; Spark refuses a reader that has it while its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Uses filters on contig and position to drop lines early; Spark applies all of them again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("contig",) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = values if self.contigs is None else self.contigs & values
            elif column == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == ("pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        options = dict(self.options)
        pushing = {k.lower(): v for k, v in options.items()}.get("pushfilters", "false").lower() == "true"
        self.options = _without_paths(options)  # this source goes to every task with its reader
        return (FilteringVcfReader if pushing else VcfReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcfSource)
