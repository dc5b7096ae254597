"""FITS tables written and read by tasks."""

import os

import pytest

from sparkburst.sources import fits

SCHEMA = "k long, t double, n int, name string, flag boolean, e float, small short"


def rows(n):
    return [(k if k % 7 else None, k / 3 if k % 5 else None, -k, f"näme {k}" if k % 4 else "", k % 2 == 0, k / 4, k % 100) for k in range(n)]


@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_round_trip(spark, tmp_path, size):
    path = f"file://{tmp_path}/t"
    want = rows(200)
    fits.write_table(spark.createDataFrame(want, SCHEMA).repartition(3), path, size)
    got = fits.read_table(spark, path, SCHEMA, size)
    as_read = [tuple(None if x is not None and x != x else x for x in r) for r in got.collect()]
    assert sorted(as_read, key=lambda r: -r[2]) == want
    assert got.rdd.getNumPartitions() >= 200 // size
    assert all(f.startswith("table-") for f in os.listdir(tmp_path / "t"))
    whole = fits.read_table(spark, path)
    assert whole.count() == 200 and [f.dataType.typeName() for f in whole.schema] == ["long", "double", "integer", "string", "boolean", "float", "short"]


def test_only_what_is_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    fits.write_table(spark.createDataFrame(rows(20), SCHEMA), path)
    got = fits.read_table(spark, path, "NAME string, n long, tfields int, absent string").collect()
    assert {(r["NAME"], r["n"], r["tfields"], r["absent"]) for r in got} == {(x[3], x[2], 7, None) for x in rows(20)}
    heads = fits.read_headers(spark, path).collect()
    assert sum(int(r["header"]["NAXIS2"]) for r in heads) == 20 and all(r["header"]["TTYPE4"] == "name" for r in heads)


def test_headers_read_no_rows(tmp_path):
    """A header is read by its own bytes, whatever the file's size."""
    import pyarrow as pa
    import pyarrow.fs

    file = tmp_path / "a.fits"
    file.write_bytes(fits.encoded(pa.table({"x": pa.array(range(100_000))})))

    class Counting:
        def __init__(self, fs):
            self.fs, self.read = fs, 0

        def open_input_file(self, path):
            outer, inner = self, self.fs.open_input_file(path)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    inner.close()

                def size(self):
                    return inner.size()

                def read_at(self, n, at):
                    outer.read += n
                    return inner.read_at(n, at)

            return File()

    fs = Counting(pa.fs.LocalFileSystem())
    cards, at = fits.table_header(fs, str(file))
    assert cards["NAXIS2"] == "100000" and at == 2 * fits.BLOCK and fs.read == 2 * fits.BLOCK
    with pytest.raises(ValueError):
        (tmp_path / "b.fits").write_bytes(b"x" * 3000)
        fits.table_header(pa.fs.LocalFileSystem(), str(tmp_path / "b.fits"))
