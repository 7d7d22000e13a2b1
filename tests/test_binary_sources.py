"""HDF5 count matrices and indexed fragment files: written, read back, read in part."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest

from lociframe.operators import intervals
from lociframe.sources import hdf5, tabix
from lociframe.sources.ranges import opened


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        self.n += n
        return self.file.read(n)


@pytest.fixture(scope="module")
def matrix():
    rnd = random.Random(2)
    return sorted({(rnd.randrange(40), rnd.randrange(500)): float(rnd.randint(1, 9)) for _ in range(4000)}.items())


def test_counts_round_trip(spark, tmp_path, matrix, rows):
    path = f"file://{tmp_path}/m"
    made = spark.createDataFrame([(f, c, v) for (f, c), v in matrix], "feature_id long, cell_id long, value double").repartition(3)
    told = rows(hdf5.write_counts(made, 40, path, cells_per_file=200))
    assert [t[1] for t in told] == [0, 200, 400] and sum(t[2] for t in told) == len(matrix)
    first = {t[0]: t[1] for t in told}

    def cells(df):
        return sorted((r.feature_id, r.cell_id + first[r.file], r.value) for r in df.collect())

    whole = [(f, c, v) for (f, c), v in matrix]
    assert cells(hdf5.counts(spark, path, cells=37)) == whole
    assert cells(hdf5.counts(spark, path, features=[3, 17, 99], cells=90)) == [r for r in whole if r[0] in (3, 17)]
    assert hdf5.counts(spark, path, features=[77]).count() == 0
    names = hdf5.column(spark, told[0][0], "names").orderBy("pos").collect()
    assert [r.value for r in names] == [f"Gene{k}" for k in range(40)]
    assert hdf5.column(spark, path, "barcodes").count() == sum(max(c - f for _, c, _ in whole if f <= c < f + 200) + 1 for f in (0, 200, 400))
    assert [r.value for r in hdf5.column(spark, told[0][0], "/matrix/shape").orderBy("pos").collect()][0] == "40"


def test_names_are_compressed_once_for_all_files():
    hdf5._stored_names.cache_clear()
    made = []
    for _ in range(3):
        one = hdf5.Writer()
        made.append(one.file({"id": one.names("f", 1234)}))
    plain = hdf5.Writer()
    assert made == [plain.file({"id": plain.dataset(np.array([f"f{k}".encode() for k in range(1234)]))})] * 3
    assert hdf5._stored_names.cache_info().misses == 1


def test_chunks_read_only_where_needed(tmp_path):
    """A tree of chunks of two levels; a range and one feature read their chunks only."""
    values = np.arange(200_000, dtype="<i8")
    made = hdf5.Writer()
    made_at = made.dataset(values, chunk=1000)
    (tmp_path / "x.h5").write_bytes(made.file({"x": made_at}))
    with opened(f"file://{tmp_path}/x.h5") as raw:
        file = Counted(raw)
        found = hdf5.Headers(file).dataset("/x")
        assert len(found.chunks) == 200 and found.length == 200_000
        before = file.n
        assert (found.read(file, 4_500, 6_500) == values[4_500:6_500]).all()
        assert file.n - before < 3 * 8000 and (found.read(file, 199_990, 200_000) == values[-10:]).all() and len(found.read(file, 5, 5)) == 0


def new_style(values, layout):
    """A file as newer writers make them: superblock 2, a header of version 2 with link messages, one dataset."""
    out = bytearray(48)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in messages)
        at = len(out)
        out.extend(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0\0\0\0")
        return at

    raw = zlib.compress(values.tobytes())
    data = len(out)
    out.extend(raw if layout == "one" else values.tobytes())
    space, kind = struct.pack("<BBBBQ", 2, 1, 0, 1, len(values)), struct.pack("<BBBBIHH", 0x10, 8, 0, 0, values.itemsize, 0, 8 * values.itemsize)
    if layout == "one":  # one chunk, filtered
        more = [(0x0B, struct.pack("<BBHHHI", 2, 1, 1, 0, 1, 4)), (0x08, struct.pack("<BBBBBIIBQIQ", 4, 2, 2, 2, 4, len(values), values.itemsize, 1, len(raw), 0, data))]
    elif layout == "plain":
        more = [(0x08, struct.pack("<BBQQ", 3, 1, data, values.nbytes))]
    else:
        more = [(0x08, struct.pack("<BBH", 3, 0, values.nbytes) + values.tobytes())]
    at = header([(0x01, space), (0x03, kind), *more])
    root = header([(0x02, struct.pack("<BBQQ", 0, 0, hdf5.UNDEFINED, hdf5.UNDEFINED)), (0x06, struct.pack("<BBB", 1, 0, 4) + b"data" + struct.pack("<Q", at))])
    out[:48] = hdf5.SIGNATURE + struct.pack("<BBBB4QI", 2, 8, 8, 0, 0, hdf5.UNDEFINED, len(out), root, 0)
    return bytes(out)


@pytest.mark.parametrize("layout", ["one", "plain", "compact"])
def test_newer_forms(tmp_path, layout):
    values = np.arange(-50, 4000, dtype="<i4")
    (tmp_path / "n.h5").write_bytes(new_style(values, layout))
    with opened(f"file://{tmp_path}/n.h5") as file:
        headers = hdf5.Headers(file)
        assert headers.keys("/") == ["data"]
        found = headers.dataset("/data")
        assert (found.read(file, 0, len(values)) == values).all() and (found.read(file, 10, 20) == values[10:20]).all()


def test_layouts(tmp_path):
    for front, names in (("", {"gene_names", "barcodes"}), ("GRCh38", {"genes"})):
        made = hdf5.Writer()
        links = {c: made.dataset(np.arange(3, dtype="<i8")) for c in ("data", "indices", "indptr", "shape", *names)}
        (tmp_path / "l.h5").write_bytes(made.file({front: made.group(links), "other": made.group({"x": links["data"]})} if front else links))
        with opened(f"file://{tmp_path}/l.h5") as file:
            found = hdf5.count_layout(hdf5.Headers(file))
        at = f"/{front}" if front else ""
        assert found["data"] == f"{at}/data" and found["barcodes"] == (f"{at}/barcodes" if "barcodes" in names else None) and found["ids"] == (f"{at}/genes" if "genes" in names else None)


def test_what_is_not_hdf5(tmp_path):
    (tmp_path / "z.h5").write_bytes(b"nothing of the kind" * 9)
    with opened(f"file://{tmp_path}/z.h5") as file, pytest.raises(ValueError, match="no HDF5"):
        hdf5.Headers(file)


# ---- fragments with an index --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fragments(spark):
    rnd = random.Random(5)
    made = []
    for k in range(60_000):
        start = rnd.randrange(1 << rnd.choice([14, 20, 26]))
        made.append((rnd.choice(["chr1", "chr2", "chrX"]), start, start + rnd.choice([1, 40, 200, 200, 20_000]), f"AACC{rnd.randrange(900)}-{'x' * rnd.randrange(30)}", rnd.randint(1, 5)))
    return spark.createDataFrame(made, "chrom string, start long, end long, barcode string, count long")


@pytest.mark.parametrize("files", [1, 3])
def test_region_by_index_equals_scan(spark, tmp_path, fragments, rows, files):
    path = f"file://{tmp_path}/f"
    told = tabix.write_indexed(fragments, path, files).collect()
    assert len(told) == files and sum(t.n_rows for t in told) == 60_000
    blocks = sum(t.n_blocks for t in told)
    for chrom, start, end in (("chr1", 0, 1 << 30), ("1", 5_000, 9_000), ("CHR2", 1 << 20, (1 << 20) + 300_000), ("chrX", 40_000_000, 40_400_000), ("chr9", 0, 10**6), ("chr2", 70_000_000, 80_000_000), ("chr1", 7, 7)):
        found = tabix.region(spark, path, chrom, start, end)
        want = rows(intervals.in_region(fragments, chrom, start, end))
        assert rows(found.drop("file", "block")) == want
        assert rows(tabix.region(spark, path, chrom, start, end, split=100_000).drop("file", "block")) == want
        touched = found.select("file", "block").distinct().count()
        assert touched <= blocks
        if end - start < 500_000 and want and start > 1 << 15:
            assert touched < blocks / 3
    whole = gzip.decompress((tmp_path / "f" / told[0].file.rsplit("/", 1)[1]).read_bytes())  # blocks are plain gzip to others
    assert whole.count(b"\n") == told[0].n_rows


def test_blocks_read_are_few(spark, tmp_path, fragments):
    """The places an index names for a small region are a small part of the file."""
    path = f"file://{tmp_path}/g"
    (told,) = tabix.write_indexed(fragments, path, 1).collect()
    with opened(told.file + ".tbi") as file:
        index = tabix.Index.read(file.read())
    size = (tmp_path / "g" / "part-00000.tsv.gz").stat().st_size
    assert sum((b >> 16) - (a >> 16) for a, b in index.places("chr2", 30_000_000, 30_010_000)) < size / 4
    assert index.places("chr7", 0, 10) == []


def test_bins():
    assert tabix.bins_of(np.array([0, 0, 16_383, 1 << 20]), np.array([1, 16_385, 16_384, (1 << 20) + 1])).tolist() == [4681, 585, 4681, 4681 + 64]
    rnd = random.Random(1)
    for _ in range(300):
        a, c = rnd.randrange(1 << 28), rnd.randrange(1 << 28)
        b, d = a + rnd.randrange(1, 1 << 22), c + rnd.randrange(1, 1 << 22)
        if a < d and c < b:
            assert int(tabix.bins_of(np.array([a]), np.array([b]))[0]) in tabix.bins_over(c, d)
