"""Count matrices in HDF5 files, as a data source that reads byte ranges in its tasks.

The driver reads headers only: superblock, groups and where the datasets' chunks begin. A partition is a run of cells; its task reads the
part of indptr it needs, then the chunks of indices that hold its entries, and chunks of data only where one of the wanted features is.
Read are old and new groups, chunked datasets by version 1 B-trees or as one chunk, contiguous and compact ones, gzip, shuffle and checksum
filters, whole numbers, floats and strings of fixed length. Other forms raise an error that names them.

A matrix is stored by cell: indptr (cells + 1), indices (features) and data (values), at /matrix, at the root or in any group of the root.
"""

from __future__ import annotations

import bisect
import functools
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import listed, opened, written

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
#: Cells of a partition, and values of a chunk that the writer makes.
CELLS = 20_000
CHUNK = 16_384


@dataclass
class Dataset:
    """Where a dataset of one dimension lies: kind (numpy type), length, and its chunks as (first value, address, bytes, filters left out)."""

    kind: str
    length: int
    chunk: int
    chunks: list[tuple[int, int, int, int]]
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    data: bytes | None = None

    def read(self, file, low: int, high: int) -> np.ndarray:
        """Values low .. high - 1: only chunks that hold some of them are read."""
        size = np.dtype(self.kind).itemsize
        if self.data is not None:
            return np.frombuffer(self.data, self.kind, high - low, low * size)
        out = np.zeros(max(0, high - low), self.kind)
        for first, address, stored, left_out in self.chunks[max(0, bisect.bisect_right(self.chunks, (low, UNDEFINED)) - 1) :]:
            if first >= high:
                break
            a, b = max(low, first), min(high, first + self.chunk)
            if a >= b:
                continue
            if not self.filters:  # part of what is stored plainly
                file.seek(address + (a - first) * size)
                out[a - low : b - low] = np.frombuffer(file.read((b - a) * size), self.kind)
                continue
            file.seek(address)
            values = np.frombuffer(self._plain(file.read(stored), left_out, size), self.kind)
            out[a - low : b - low] = values[a - first : b - first]
        return out

    def _plain(self, raw: bytes, left_out: int, size: int) -> bytes:
        for k, (name, values) in reversed(list(enumerate(self.filters))):
            if left_out >> k & 1:
                continue
            if name == 1:
                raw = zlib.decompress(raw)
            elif name == 2:
                size = values[0] if values else size
                whole = len(raw) // size * size
                raw = np.frombuffer(raw, np.uint8, whole).reshape(size, -1).T.tobytes() + raw[whole:]
            elif name == 3:
                raw = raw[:-4]
            else:
                raise ValueError(f"HDF5 filter {name} isn't read")
        return raw


class Headers:
    """The objects of a file: keys() of a group and dataset() of a path."""

    def __init__(self, file) -> None:
        self.file = file
        start = self._at(0, 64)
        if start[:8] != SIGNATURE:
            raise ValueError("no HDF5 file")
        version = start[8]
        if version < 2:
            at = 24 + 4 * version
            self._sizes(start[13], start[14])
            self.base = int.from_bytes(start[at : at + 8], "little")
            self.root = int.from_bytes(self._at(at + 4 * 8 + 8, 8), "little")
        else:
            self._sizes(start[9], start[10])
            self.base, _, _, self.root = struct.unpack("<4Q", start[12:44])

    @staticmethod
    def _sizes(offsets: int, lengths: int) -> None:
        if (offsets, lengths) != (8, 8):
            raise ValueError("HDF5 files with offsets of other than 8 bytes aren't read")

    def _at(self, address: int, n: int) -> bytes:
        self.file.seek(address)
        return self.file.read(n)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object header's messages."""
        address += self.base
        head = self._at(address, 16)
        if head[:4] == b"OHDR":
            return self._new_messages(address, head)
        if head[0] != 1:
            raise ValueError(f"HDF5 object headers of version {head[0]} aren't read")
        out, blocks = [], [(address + 16, struct.unpack("<I", head[8:12])[0])]
        while blocks:
            at, n = blocks.pop(0)
            block, k = self._at(at, n), 0
            while k + 8 <= n:
                kind, size = struct.unpack("<HH", block[k : k + 4])
                data = block[k + 8 : k + 8 + size]
                if kind == 0x10:
                    where, length = struct.unpack("<2Q", data[:16])
                    blocks.append((where + self.base, length))
                else:
                    out.append((kind, data))
                k += 8 + size
        return out

    def _new_messages(self, address: int, head: bytes) -> list[tuple[int, bytes]]:
        flags, at = head[5], 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(self._at(address + at, width), "little")
        out, blocks = [], [(address + at + width, n)]
        while blocks:
            where, n = blocks.pop(0)
            block, k, more = self._at(where, n), 0, 6 if flags & 4 else 4
            while k + more <= n:
                kind, size = block[k], int.from_bytes(block[k + 1 : k + 3], "little")
                data = block[k + more : k + more + size]
                if kind == 0x10:
                    to, length = struct.unpack("<2Q", data[:16])
                    blocks.append((to + self.base + 4, length - 8))  # without its signature and checksum
                else:
                    out.append((kind, data))
                k += more + size
        return out

    def _links(self, address: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, data in self.messages(address):
            if kind == 0x11:
                tree, heap = struct.unpack("<2Q", data[:16])
                names = self._at(heap + self.base, 32)
                size, _, segment = struct.unpack("<3Q", names[8:32])
                held = self._at(segment + self.base, size)
                for leaf in self._children(tree, 0):
                    node = self._at(leaf + self.base, 8)
                    entries = self._at(leaf + self.base + 8, 40 * struct.unpack("<H", node[6:8])[0])
                    for k in range(0, len(entries), 40):
                        name, header = struct.unpack("<2Q", entries[k : k + 16])
                        out[held[name : held.index(b"\0", name)].decode()] = header
            elif kind == 0x06:
                flags, at = data[1], 2
                soft = flags & 8 and data[at] != 0
                at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(data[at : at + width], "little")
                if not soft:
                    out[data[at + width : at + width + n].decode()] = struct.unpack("<Q", data[at + width + n : at + width + n + 8])[0]
            elif kind == 0x02 and struct.unpack("<Q", data[2 + (8 if data[1] & 1 else 0) :][:8])[0] != UNDEFINED:
                raise ValueError("HDF5 groups with dense links aren't read")
        return out

    def _children(self, address: int, rank: int) -> Iterator:
        """Leaves of a version 1 B-tree: addresses of symbol nodes, or with a rank (first value, address, bytes, filters left out)."""
        node = self._at(address + self.base, 24)
        if node[:4] != b"TREE":
            raise ValueError("HDF5 chunk indexes other than version 1 B-trees aren't read")
        level, n = node[5], struct.unpack("<H", node[6:8])[0]
        key = 8 if not rank else 8 + 8 * (rank + 1)
        body = self._at(address + self.base + 24, n * (key + 8) + key)
        for k in range(n):
            at = k * (key + 8)
            child = struct.unpack("<Q", body[at + key : at + key + 8])[0]
            if level:
                yield from self._children(child, rank)
            elif rank:
                size, left_out, first = struct.unpack("<IIQ", body[at : at + 16])
                yield first, child + self.base, size, left_out
            else:
                yield child

    def address(self, path: str) -> int | None:
        at = self.root
        for part in filter(None, path.split("/")):
            at = self._links(at).get(part)
            if at is None:
                return None
        return at

    def keys(self, path: str) -> list[str]:
        at = self.address(path)
        return sorted(self._links(at)) if at is not None else []

    def dataset(self, path: str) -> Dataset:
        at = self.address(path)
        if at is None:
            raise KeyError(path)
        found = dict(self.messages(at))
        space, kind, layout = found[0x01], found[0x03], found[0x08]
        rank = space[1]
        if rank != 1:
            raise ValueError(f"{path}: HDF5 datasets of {rank} dimensions aren't read")
        length = struct.unpack("<Q", space[8 if space[0] == 1 else 4 :][:8])[0]
        out = Dataset(_kind(path, kind), length, max(1, length), [], _filters(found.get(0x0B)))
        size = np.dtype(out.kind).itemsize
        if layout[0] == 3 and layout[1] == 0:
            out.data = layout[4 : 4 + struct.unpack("<H", layout[2:4])[0]]
        elif layout[0] in (3, 4) and layout[1] == 1:
            where = struct.unpack("<Q", layout[2:10])[0]
            out.chunks = [] if where == UNDEFINED else [(0, where + self.base, length * size, 0)]
        elif layout[0] == 3 and layout[1] == 2:
            tree, out.chunk = struct.unpack("<QI", layout[3:15])
            out.chunks = [] if tree == UNDEFINED else sorted(self._children(tree, 1))
        elif layout[0] == 4 and layout[1] == 2:
            flags, width = layout[2], layout[4]
            at = 5 + layout[3] * width
            if layout[at] != 1:
                raise ValueError(f"{path}: HDF5 chunk indexes of kind {layout[at]} aren't read")
            out.chunk = int.from_bytes(layout[5 : 5 + width], "little")
            stored, left_out = struct.unpack("<QI", layout[at + 1 : at + 13]) if flags & 2 else (length * size, 0)
            where = struct.unpack("<Q", layout[-8:])[0]
            out.chunks = [] if where == UNDEFINED else [(0, where + self.base, stored, left_out)]
        else:
            raise ValueError(f"{path}: HDF5 layouts of version {layout[0]} and class {layout[1]} aren't read")
        return out


def _kind(path: str, message: bytes) -> str:
    size, bits = struct.unpack("<I", message[4:8])[0], message[1]
    group = message[0] & 15
    if group == 3:
        return f"S{size}"
    if group not in (0, 1):
        raise ValueError(f"{path}: HDF5 types of class {group} aren't read")
    return (">" if bits & 1 else "<") + ("f" if group == 1 else "i" if bits & 8 else "u") + str(size)


def _filters(message: bytes | None) -> list[tuple[int, tuple[int, ...]]]:
    if message is None:
        return []
    version, n, at, out = message[0], message[1], 8 if message[0] == 1 else 2, []
    for _ in range(n):
        name = struct.unpack("<H", message[at : at + 2])[0]
        at += 2
        length = 0
        if version == 1 or name >= 256:
            length = struct.unpack("<H", message[at : at + 2])[0]
            at += 2
        values = struct.unpack("<H", message[at + 2 : at + 4])[0]
        at += 4 + (-(-length // 8) * 8 if version == 1 else length)
        out.append((name, struct.unpack(f"<{values}I", message[at : at + 4 * values])))
        at += 4 * values + (4 if version == 1 and values % 2 else 0)
    return out


def count_layout(headers: Headers) -> dict[str, str | None]:
    """The paths of a count matrix: data, indices, indptr, shape, barcodes, names and ids; names, ids and barcodes may be missing."""
    root = headers.keys("/")
    if "matrix" in root:
        held = headers.keys("/matrix/features")
        names = {"names": "/matrix/features/name" if "name" in held else None, "ids": "/matrix/features/id" if "id" in held else None}
        return {c: f"/matrix/{c}" for c in ("data", "indices", "indptr", "shape", "barcodes")} | names
    front = ""
    if "data" not in root:
        groups = (f"/{k}" for k in root)
        front = next((g for g in groups if {"data", "indices", "indptr"} <= set(headers.keys(g))), "")
    held = headers.keys(front or "/")
    one = lambda c: f"{front}/{c}" if c in held else None
    return {c: f"{front}/{c}" for c in ("data", "indices", "indptr", "shape")} | {"barcodes": one("barcodes"), "names": one("gene_names"), "ids": one("genes")}


@dataclass
class Cells(InputPartition):
    path: str
    low: int
    high: int


class CountReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.cells = options["path"], int(options.get("cells", CELLS))
        self.features = np.array(sorted(int(x) for x in options["features"].split(","))) if options.get("features") else None

    def partitions(self) -> list[Cells]:
        out = []
        for path in listed(self.path, ".h5"):
            with opened(path) as file:
                headers = Headers(file)
                n = headers.dataset(count_layout(headers)["indptr"]).length - 1
            out += [Cells(path, low, min(low + self.cells, n)) for low in range(0, n, self.cells)]
        return out or [Cells("", 0, 0)]

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        with opened(partition.path) as file:
            headers = Headers(file)
            layout = count_layout(headers)
            indptr, indices, data = (headers.dataset(layout[c]) for c in ("indptr", "indices", "data"))
            ends = indptr.read(file, partition.low, partition.high + 1).astype(np.int64)
            step = max(1, indices.chunk) if indices.filters else 1 << 20
            low = int(ends[0])
            while low < ends[-1]:
                high = min(int(ends[-1]), (low // step + 1) * step)  # chunk by chunk
                feature = indices.read(file, low, high).astype(np.int64)
                pick = np.arange(len(feature)) if self.features is None else np.flatnonzero(np.isin(feature, self.features))
                if len(pick):
                    value = data.read(file, low, high).astype(float)[pick]
                    cell = partition.low + np.searchsorted(ends, low + pick, "right") - 1
                    names = ["file", "feature_id", "cell_id", "value"]
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(pick)), pa.array(feature[pick]), pa.array(cell), pa.array(value)], names=names)
                low = high


class CountSource(DataSource):
    """Options path (a file, or a folder of .h5 files), features (numbers, comma-separated: all others are left out), cells (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "hdf5counts"

    def schema(self) -> str:
        return "file string, feature_id long, cell_id long, value double"

    def reader(self, schema) -> CountReader:
        return CountReader(self.options)


def counts(spark: SparkSession, path: str, features: list[int] | None = None, cells: int = CELLS) -> DataFrame:
    """file, feature_id and cell_id (from 0 in each file) and value of the matrices at path; with features, only theirs."""
    spark.dataSource.register(CountSource)
    found = spark.read.format("hdf5counts").option("cells", cells)
    return (found if features is None else found.option("features", ",".join(map(str, features)))).load(path)


def column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """file, pos and value (string) of a dataset of one dimension in each file at path, read chunk by chunk in tasks. name is a path in
    the file, or one of count_layout()'s names."""
    parts = []
    for one in listed(path, ".h5"):
        with opened(one) as file:
            headers = Headers(file)
            inner = name if name.startswith("/") else count_layout(headers)[name]
            if inner is not None:
                found = headers.dataset(inner)
                step = max(found.chunk, 1 << 16) if found.chunk < found.length else 1 << 16
                parts += [(one, inner, low, min(low + step, found.length)) for low in range(0, found.length, step)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in batch.to_pylist():
                with opened(part["file"]) as file:
                    values = Headers(file).dataset(part["inner"]).read(file, part["low"], part["high"])
                texts = [v.decode() for v in values] if values.dtype.kind == "S" else [str(v) for v in values.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([part["file"]] * len(texts)), pa.array(np.arange(part["low"], part["high"])), pa.array(texts)], names=["file", "pos", "value"])

    asked = spark.createDataFrame(parts, "file string, inner string, low long, high long")
    return asked.repartition(max(1, min(len(parts), 1000))).mapInArrow(run, "file string, pos long, value string")


# ---- writing ------------------------------------------------------------------------------------------------


def _stored(part: np.ndarray, chunk: int, level: int) -> bytes:
    """A chunk's values, filled up with zeros, as they are stored."""
    whole = np.zeros(chunk, part.dtype)
    whole[: len(part)] = part
    return zlib.compress(np.frombuffer(whole.tobytes(), np.uint8).reshape(chunk, -1).T.tobytes(), level)


@functools.lru_cache(maxsize=4)
def _stored_names(front: str, n: int, chunk: int, level: int) -> tuple[np.dtype, list[bytes]]:
    """The type and the stored chunks of front0, front1, ..: made once in a worker, as all files of a matrix hold the same."""
    kind = np.dtype(f"S{len(front) + len(str(max(n - 1, 0)))}")
    return kind, [_stored(np.array([f"{front}{k}".encode() for k in range(low, min(low + chunk, n))], kind), chunk, level) for low in range(0, n, chunk)]


class Writer:
    """A file of groups and datasets of one dimension, gzip-compressed in chunks behind a shuffle, in the oldest form that all readers know."""

    def __init__(self) -> None:
        self.out = bytearray(96)

    def _put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, -(-len(d) // 8) * 8, 0) + d + b"\0" * (-len(d) % 8) for kind, d in messages)
        return self._put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def names(self, front: str, n: int, chunk: int = CHUNK, level: int = 4) -> int:
        """A dataset of front0 .. front(n - 1)."""
        kind, stored = _stored_names(front, n, chunk, level)
        return self._dataset(kind, n, stored, chunk, level)

    def dataset(self, values: np.ndarray, chunk: int = CHUNK, level: int = 4) -> int:
        return self._dataset(values.dtype, len(values), (_stored(values[low : low + chunk], chunk, level) for low in range(0, len(values), chunk)), chunk, level)

    def _dataset(self, kind: np.dtype, n: int, stored: Iterable[bytes], chunk: int, level: int) -> int:
        if kind.kind == "S":
            type_ = struct.pack("<BBBBI", 0x13, 1, 0, 0, kind.itemsize)
        elif kind.kind == "f":
            exponent, mantissa = (8, 23) if kind.itemsize == 4 else (11, 52)
            type_ = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, kind.itemsize * 8 - 1, 0, kind.itemsize, 0, kind.itemsize * 8, mantissa, exponent, 0, mantissa, (1 << (exponent - 1)) - 1)
        else:
            type_ = struct.pack("<BBBBIHH", 0x10, 8 if kind.kind == "i" else 0, 0, 0, kind.itemsize, 0, kind.itemsize * 8)
        messages = [(0x01, struct.pack("<BBBB4xQ", 1, 1, 0, 0, n)), (0x03, type_), (0x05, struct.pack("<BBBB", 2, 2, 2, 0))]
        places = [(k * chunk, self._put(raw), len(raw)) for k, raw in enumerate(stored)]
        tree = self._tree([(struct.pack("<IIQQ", size, 0, low, 0), at) for low, at, size in places], struct.pack("<IIQQ", 0, 0, len(places) * chunk, 0), 1, 32) if places else UNDEFINED
        shuffle, gzip = struct.pack("<HHHHII", 2, 0, 1, 1, kind.itemsize, 0), struct.pack("<HHHHII", 1, 0, 1, 1, level, 0)
        messages += [(0x0B, struct.pack("<BB6x", 1, 2) + shuffle + gzip), (0x08, struct.pack("<BBBQII", 3, 2, 2, tree, chunk, kind.itemsize))]
        return self._header(messages)

    def _tree(self, entries: list[tuple[bytes, int]], last: bytes, kind: int, width: int) -> int:
        """A version 1 B-tree of entries (key, child); nodes are padded to the size that width gives them."""
        level, full = 0, 24 + 2 * width * (len(last) + 8) + len(last)
        while True:
            above = []
            for k in range(0, len(entries), 2 * width):
                part = entries[k : k + 2 * width]
                end = entries[k + 2 * width][0] if k + 2 * width < len(entries) else last
                node = struct.pack("<4sBBHQQ", b"TREE", kind, level, len(part), UNDEFINED, UNDEFINED) + b"".join(key + struct.pack("<Q", child) for key, child in part) + end
                above.append((part[0][0], self._put(node.ljust(full, b"\0"))))
            if len(above) == 1:
                return above[0][1]
            entries, level = above, level + 1

    def _group(self, links: dict[str, int]) -> tuple[int, int, int]:
        names, heap = sorted(links), bytearray(8)
        at = {}
        for name in names:
            at[name] = len(heap)
            heap += name.encode() + b"\0"
            heap += b"\0" * (-len(heap) % 8)
        segment = self._put(bytes(heap))
        heap_at = self._put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), 1, segment))
        leaves = []
        for k in range(0, len(names), 8):  # twice the leaf's K
            part = names[k : k + 8]
            node = struct.pack("<4sBBH", b"SNOD", 1, 0, len(part)) + b"".join(struct.pack("<QQII16x", at[n], links[n], 0, 0) for n in part)
            leaves.append((struct.pack("<Q", at[names[k - 1]] if k else 0), self._put(node.ljust(8 + 8 * 40, b"\0"))))
        tree = self._tree(leaves, struct.pack("<Q", at[names[-1]]), 0, 16)
        return self._header([(0x11, struct.pack("<QQ", tree, heap_at))]), tree, heap_at

    def group(self, links: dict[str, int]) -> int:
        return self._group(links)[0]

    def file(self, links: dict[str, int]) -> bytes:
        root, tree, heap = self._group(links)
        head = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<4Q", 0, UNDEFINED, len(self.out), UNDEFINED)
        self.out[:96] = (head + struct.pack("<QQII", 0, root, 1, 0) + struct.pack("<QQ", tree, heap)).ljust(96, b"\0")
        return bytes(self.out)


def write_counts(matrix: DataFrame, n_features: int, path: str, cells_per_file: int = 1_000_000) -> DataFrame:
    """Write counts (feature_id, cell_id, value; ids from 0) as a folder of .h5 files, one for each run of so many cells, by tasks.
    file, first (its first cell_id) and n_entries, a row for each file. A task holds one file's entries."""

    def run(keys, rows):
        part = int(keys[0])
        rows = rows.sort_values(["cell_id", "feature_id"], kind="stable")
        cell = rows["cell_id"].to_numpy() - part * cells_per_file
        n = int(cell.max()) + 1
        made = Writer()
        ends = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=n)))).astype("<i8")
        held = {"data": rows["value"].to_numpy("<f4" if (rows["value"].astype("float32") == rows["value"]).all() else "<f8"), "indices": rows["feature_id"].to_numpy("<i8"), "indptr": ends, "shape": np.array([n_features, n], "<i4"), "barcodes": np.array([f"cell-{part * cells_per_file + k}".encode() for k in range(n)])}
        links = {name: made.dataset(values) for name, values in held.items()}
        links["features"] = made.group({"id": made.names("f", n_features), "name": made.names("Gene", n_features)})
        name = f"{path}/cells-{part:06d}.h5"
        written(name, made.file({"matrix": made.group(links)}))
        return pd.DataFrame({"file": [name], "first": [part * cells_per_file], "n_entries": [len(rows)]})

    parts = matrix.select("feature_id", "cell_id", F.col("value").cast("double").alias("value"), F.floor(F.col("cell_id") / cells_per_file).alias("part"))
    return parts.groupBy("part").applyInPandas(run, "file string, first long, n_entries long")
