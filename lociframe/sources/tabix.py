"""Fragment files in blocks (BGZF) with a tabix index: a data source whose tasks read only the blocks that an index names for a region.

A file is rows of chrom, start, end, barcode and count, sorted by chrom and start, as gzip blocks of 64 KB; the index gives, by nested bins
of positions, where rows begin, and by windows of 16,384 positions, where the first that reaches one does. Places in a file are a block's
first byte (48 bits) and a byte in its contents (16 bits).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.intervals import in_region
from .ranges import listed, opened, written

#: The format's constants (fixed values): contents of a block, the empty last block, bits of a window and of each of five levels of bins, the
#: bin that holds no places.
BLOCK = 0xFF00
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW_BITS, LEVEL_BITS, LEVELS, NO_BIN = 14, 3, 5, 37450
#: Compressed bytes that a task reads about.
SPLIT = 32 << 20


def first_bin(level: int) -> int:
    return ((1 << LEVEL_BITS * level) - 1) // 7


def bins_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds each interval [start, end)."""
    out, open_ = np.zeros(len(start), np.int64), np.ones(len(start), bool)
    for level in range(LEVELS, 0, -1):
        shift = WINDOW_BITS + LEVEL_BITS * (LEVELS - level)
        fits = open_ & (start >> shift == (end - 1) >> shift)
        out[fits] = first_bin(level) + (start[fits] >> shift)
        open_ &= ~fits
    return out


def bins_over(start: int, end: int) -> set[int]:
    """All bins that may hold an interval over some of [start, end)."""
    out = {0}
    for level in range(1, LEVELS + 1):
        shift = WINDOW_BITS + LEVEL_BITS * (LEVELS - level)
        out.update(range(first_bin(level) + (start >> shift), first_bin(level) + (end - 1 >> shift) + 1))
    return out


@dataclass
class Index:
    """By chromosome: the places of each bin's rows, and by window the first place."""

    chroms: dict[str, tuple[dict[int, list[tuple[int, int]]], list[int]]]

    @classmethod
    def read(cls, data: bytes) -> Index:
        raw = b"".join(text for _, text in _blocks(data))
        if raw[:4] != b"TBI\1":
            raise ValueError("no tabix index")
        n = struct.unpack("<i", raw[4:8])[0]
        length = struct.unpack("<i", raw[32:36])[0]
        names, at, out = raw[36 : 36 + length].split(b"\0"), 36 + length, {}
        for k in range(n):
            bins = {}
            (many,) = struct.unpack("<i", raw[at : at + 4])
            at += 4
            for _ in range(many):
                number, places = struct.unpack("<Ii", raw[at : at + 8])
                at += 8
                values = struct.unpack(f"<{2 * places}Q", raw[at : at + 16 * places])
                at += 16 * places
                if number != NO_BIN:
                    bins[number] = list(zip(values[::2], values[1::2], strict=True))
            (many,) = struct.unpack("<i", raw[at : at + 4])
            out[names[k].decode()] = (bins, list(struct.unpack(f"<{many}Q", raw[at + 4 : at + 4 + 8 * many])))
            at += 4 + 8 * many
        return cls(out)

    def places(self, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
        """Runs of the file that hold all rows of a chromosome over [start, end), in order, without overlap."""
        bare = lambda c: c.lower().removeprefix("chr")
        found = []
        for name, (bins, windows) in self.chroms.items():
            if bare(name) == bare(chrom):
                window = min(start >> WINDOW_BITS, len(windows) - 1)
                least = windows[window] if windows else 0
                found += [(max(a, least), b) for k in bins_over(start, end) & set(bins) for a, b in bins[k] if b > least]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a >> 16 <= out[-1][1] >> 16:  # in the same block, or the next
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def parted(self, first: int, last: int, size: int) -> list[tuple[int, int]]:
        """A run in parts of about size bytes, cut where the index knows a row to begin."""
        known = sorted({x for bins, windows in self.chroms.values() for x in (*windows, *(p for places in bins.values() for p, _ in places)) if first < x < last})
        cuts = [first]
        for x in known:
            if (x >> 16) - (cuts[-1] >> 16) >= size:
                cuts.append(x)
        return list(zip(cuts, [*cuts[1:], last], strict=True))


def _blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Where each block begins, and its contents."""
    at = 0
    while at + 18 <= len(data):
        size = struct.unpack("<H", data[at + 16 : at + 18])[0] + 1
        yield at, zlib.decompress(data[at + 18 : at + size - 8], -15)
        at += size


@dataclass
class Run(InputPartition):
    path: str
    first: int
    last: int


class RegionReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chrom = options["path"], options["chrom"]
        # rows that only touch the region count too
        self.start, self.end = max(0, int(options["start"]) - 1), int(options["end"]) + 1
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Run]:
        out: list[Run] = []
        for path in listed(self.path, ".tsv.gz"):
            with opened(path + ".tbi") as file:
                index = Index.read(file.read())
            out += [Run(path, a, b) for first, last in index.places(self.chrom, self.start, self.end) for a, b in index.parted(first, last, self.split)]
        return out or [Run("", 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        """The rows that begin in the run, block by block; the last may go on in the next block."""
        if run.first == run.last:
            return
        last, until = run.last >> 16, run.last & 0xFFFF
        with opened(run.path) as file:
            at, skip, held, begun = run.first >> 16, run.first & 0xFFFF, b"", run.first >> 16
            while at < last or at == last and until or held:
                file.seek(at)
                head = file.read(18)
                if len(head) < 18:
                    break
                size = struct.unpack("<H", head[16:18])[0] + 1
                text = zlib.decompress(file.read(size - 18)[:-8], -15)
                stop = len(text) if at < last else self._line_end(text, until if at == last else 1)
                whole, _, rest = (held + text[skip:stop]).rpartition(b"\n")
                if whole:
                    yield self._rows(run.path, begun, whole)
                if stop < len(text) or at > last:
                    break
                held, begun = rest, begun if not whole and rest else at + size if not rest else at
                at, skip = at + size, 0

    @staticmethod
    def _line_end(text: bytes, at: int) -> int:
        """Where rows that begin before a place end in a block."""
        if at == 0:
            return 0
        found = text.find(b"\n", at - 1)
        return len(text) if found < 0 else found + 1

    @staticmethod
    def _rows(path: str, block: int, lines: bytes) -> pa.RecordBatch:
        parts = [x.split("\t") for x in lines.decode().split("\n") if x and not x.startswith("#")]
        parts = [p for p in parts if len(p) >= 4]
        columns = [[p[0] for p in parts], [int(p[1]) for p in parts], [int(p[2]) for p in parts], [p[3] for p in parts], [int(p[4]) if len(p) > 4 and p[4] else 1 for p in parts]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)] + [pa.array([path] * len(parts), pa.string()), pa.array([block] * len(parts), pa.int64())], names=["chrom", "start", "end", "barcode", "count", "file", "block"])


class RegionSource(DataSource):
    """Options path (a .tsv.gz file with its .tbi, or a folder of them), chrom, start, end, split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "indexedfragments"

    def schema(self) -> str:
        return "chrom string, start long, end long, barcode string, count long, file string, block long"

    def reader(self, schema) -> RegionReader:
        return RegionReader(self.options)


def region(spark: SparkSession, path: str, chrom: str, start: int, end: int, split: int = SPLIT) -> DataFrame:
    """The fragments of a region with the file and block each was read from: what in_region() leaves of all, of the blocks that the index names."""
    spark.dataSource.register(RegionSource)
    found = spark.read.format("indexedfragments").option("chrom", chrom).option("start", start).option("end", end).option("split", split).load(path)
    return in_region(found, chrom, start, end)


def write_indexed(fragments: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write fragments as a folder of block files with an index each, by ranges of (chrom, start): file, n_rows, n_blocks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(it)) if (it := list(it)) else pd.DataFrame()
        if not len(rows):
            return
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.tsv.gz"
        lines = (rows["chrom"] + "\t" + rows["start"].astype(str) + "\t" + rows["end"].astype(str) + "\t" + rows["barcode"] + "\t" + rows["count"].astype(str) + "\n").str.encode("utf-8")
        text = b"".join(lines)
        blocks, begins = _packed(text)
        written(name, blocks)
        ends = np.concatenate(([0], np.cumsum(lines.str.len().to_numpy())))
        written(name + ".tbi", _packed(_index(rows, (begins[ends // BLOCK] << 16) | (ends % BLOCK)))[0])
        yield pd.DataFrame({"file": [name], "n_rows": [len(rows)], "n_blocks": [len(begins) - 1]})

    rows = fragments.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("barcode").cast("string").alias("barcode"), F.col("count").cast("long").alias("count"))
    dealt = rows.repartitionByRange(files, "chrom", "start") if files else rows.repartitionByRange("chrom", "start")
    return dealt.sortWithinPartitions("chrom", "start", "end", "barcode").mapInPandas(run, "file string, n_rows long, n_blocks long")


def _packed(text: bytes) -> tuple[bytes, np.ndarray]:
    """text in blocks, and where each begins (with the end, or the last block)."""
    out, begins = bytearray(), []
    for low in range(0, len(text), BLOCK):
        part, made = text[low : low + BLOCK], zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = made.compress(part) + made.flush()
        begins.append(len(out))
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return bytes(out + LAST), np.array([*begins, len(out)], np.int64)


def _index(rows: pd.DataFrame, places: np.ndarray) -> bytes:
    """The index of sorted rows that begin at places (one more: the end)."""
    chrom, start, end = rows["chrom"].to_numpy(), rows["start"].to_numpy(), rows["end"].to_numpy()
    edges = [0, *(np.flatnonzero(chrom[1:] != chrom[:-1]) + 1), len(rows)]
    names = b"".join(chrom[k].encode() + b"\0" for k in edges[:-1])
    out = [b"TBI\1", struct.pack("<8i", len(edges) - 1, 0x10000, 1, 2, 3, ord("#"), 0, len(names)), names]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        s, e = start[low:high], np.maximum(end[low:high], start[low:high] + 1)
        number = bins_of(s, e)
        cuts = np.concatenate(([0], np.flatnonzero(number[1:] != number[:-1]) + 1, [high - low]))
        held: dict[int, list[bytes]] = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.setdefault(int(number[a]), []).append(struct.pack("<QQ", places[low + a], places[low + b]))
        out.append(struct.pack("<i", len(held)))
        for k in sorted(held):
            out += [struct.pack("<Ii", k, len(held[k])), *held[k]]
        # the first row that reaches each window; windows that none reaches take that of the next
        reach = np.full(int(e.max() - 1 >> WINDOW_BITS) + 1, high - low, np.int64)
        wide = (e - 1 >> WINDOW_BITS) - (s >> WINDOW_BITS)
        for k in range(int(wide.max()) + 1):
            of = np.flatnonzero(wide >= k)
            np.minimum.at(reach, (s[of] >> WINDOW_BITS) + k, of)
        reach = np.minimum.accumulate(reach[::-1])[::-1]
        out += [struct.pack("<i", len(reach)), places[low + reach].astype("<u8").tobytes()]
    return b"".join(out)
