"""Golden values, edge semantics, files byte by byte, threads, and random arrays against numpy."""

import itertools
import random
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from labelgrid import Dataset, LabeledArray, Slot, Status, add, add_into, catalog, data_array, isel, mean, mean_into, read_netcdf, sel, write_netcdf
from labelgrid.status import LabelGridError

NAN = float("nan")


def grid(array):
    """Cells as a numpy array in the order of the dimensions."""
    out = np.full(array.shape, np.nan)
    for row in array.cells.collect():
        out[tuple(i - 1 for i in row[:-1])] = row.value
    return out


def linear(array):
    return [r.value for r in array.values_df().collect()]


@pytest.fixture(scope="module")
def potential(spark):
    values = np.array([[[100 * z + 10 * t + r for z in (1, 2)] for t in (1, 2, 3)] for r in (1, 2)], "f8")
    return data_array(spark, values, ["radius", "theta", "zeta"], "potential").set_coord("radius", [0.25, 0.75])


def test_golden_values(spark, potential):
    assert (potential.dims, potential.shape, potential.strides, potential.size(), potential.rank()) == (("radius", "theta", "zeta"), (2, 3, 2), (1, 2, 6), 12, 3)
    near = potential.sel("radius", 0.7, "nearest")
    assert near.dims == ("theta", "zeta") and linear(near) == [112, 122, 132, 212, 222, 232]
    over = potential.mean("theta")
    assert over.dims == ("radius", "zeta") and linear(over) == [121, 122, 221, 222] and list(over.coords) == ["radius"]
    out = Slot(data_array(spark, [9.0], ["old"], "old"))
    mean_into(potential, "theta", out)
    assert linear(out.array) == [121, 122, 221, 222]
    total = potential + data_array(spark, [1.0, 2.0, 3.0], ["theta"])
    assert total.shape == (2, 3, 2) and linear(total)[:6] == [112, 113, 123, 124, 134, 135] and total.coords == {}
    held = Dataset()
    held.attrs["title"] = "run 7"
    held.set("potential ", potential)
    assert held.has("potential") and held.size() == 1 and held.attrs == {"title": "run 7"} and linear(held.get("potential")) == linear(potential)
    assert linear(data_array(spark, [[1, 3], [2, 4]], ["radius", "theta"]).mean("theta")) == [2, 3]
    ones = data_array(spark, np.ones((64, 4, 3)), ["radius", "theta", "zeta"]).set_coord("radius", [k / 63 for k in range(64)])
    assert linear(ones.sel("radius", 0.5, "nearest").mean("zeta")) == [1.0] * 4


def test_means_from_threads(spark):
    values = np.arange(64 * 128, dtype="f8").reshape(128, 64).T + 1

    def run(k):
        return linear(data_array(spark, values + k, ["radius", "theta"]).mean("theta"))

    with ThreadPoolExecutor(8) as pool:
        for k, got in enumerate(pool.map(run, range(1, 33)), 1):
            assert np.abs(np.array(got) - (np.arange(1, 65) + 64 * 63.5 + k)).max() < 1e-9


def test_results_agree_with_raw_loops(spark):
    flat = np.sin(np.arange(1, 32 * 256 + 1) * 1e-4)
    values = flat.reshape(256, 32).T
    a, b = data_array(spark, values, ["radius", "theta"]), data_array(spark, values / 2, ["radius", "theta"])
    assert np.abs(grid(a.mean("theta")) - values.mean(axis=1)).max() <= 1e-12
    assert np.abs(grid(a.chunked().mean("radius")) - values.mean(axis=0)).max() <= 1e-12
    assert np.abs(grid(a + b) - (values + values / 2)).max() <= 1e-12
    assert np.abs(grid(a.chunked() + b.chunked()) - (values + values / 2)).max() <= 1e-12
    in_order = [float(np.cumsum(row)[-1] / 256) for row in values]
    assert grid(mean(a, "theta", ordered=True)).tolist() == in_order  # the same bits


def test_random_arrays_equal_numpy(spark):
    rng = random.Random(12)
    for _ in range(10):
        rank = rng.randint(1, 4)
        names = rng.sample("pqrstu", rank)
        shape = [rng.randint(1, 4) for _ in names]
        x = np.array([rng.uniform(-9, 9) for _ in range(int(np.prod(shape)))]).reshape(shape)
        a = data_array(spark, x, names)
        assert a.valid(deep=True) and np.array_equal(grid(a), x)
        k = rng.randrange(rank)
        at = rng.randint(1, shape[k])
        assert np.array_equal(grid(a.isel(names[k], at)), np.take(x, at - 1, axis=k))
        assert np.allclose(grid(a.mean(names[k])), x.mean(axis=k), atol=1e-12)
        other = rng.sample(names, rng.randint(0, min(rank, 3))) + rng.sample("vw", rng.randint(0, 1))
        sizes = dict(zip(names, shape)) | {"v": 2, "w": 3}
        y = np.array([rng.uniform(-9, 9) for _ in range(int(np.prod([sizes[n] for n in other])))]).reshape([sizes[n] for n in other])
        total = a + data_array(spark, y, other)
        union = names + [n for n in other if n not in names]
        assert total.dims == tuple(union)
        want = np.einsum(x, [union.index(n) for n in names], np.ones([sizes[n] for n in union]), range(len(union)), range(len(union)))
        want += np.einsum(y, [union.index(n) for n in other], np.ones([sizes[n] for n in union]), range(len(union)), range(len(union)))
        assert np.allclose(grid(total), want, atol=1e-12)


def test_edges(spark):
    marks = data_array(spark, [1.0, 2.0, 3.0], ["x"])
    at = lambda coord, v, how=None: (lambda got: linear(got) if got.valid() else None)(marks.set_coord("x", coord).sel("x", v, how))
    assert at([1, 2, 3], 2) == [2] and at([1, 2, 3], 2.5) is None
    assert at([NAN, 1, 2], NAN) is None and at([NAN, 1, 2], NAN, "nearest") == [1]  # E1, E5
    assert at([-0.0, 1, 2], 0.0) == [1]  # E2
    assert at([0.25, 0.75, 5], 0.5, "nearest") == [1] and at([9, 1, 5], 6, "nearest ") == [3]  # E3
    assert at([NAN, NAN, 4], -7, "nearest") == [3] and at([NAN, NAN, NAN], 3, "nearest") == [1]  # E4
    assert at([7, 7, 7], 7) == [1] and at([8, 7, 7], 6, "nearest") == [2]  # E10
    inf = float("inf")
    special = data_array(spark, [inf, -inf, NAN], ["x"])
    assert np.array_equal(grid(special + special), [inf, -inf, NAN], equal_nan=True)  # E9
    assert np.isnan(grid(special.mean("x")))
    huge = data_array(spark, 0.0)._with(dims=("a", "b"), shape=(100_000, 100_000))
    assert huge.meta.cells == 10**10 and huge.strides == (1, 100_000)  # E12


def test_status_table(spark, potential):
    def code(run):
        stat = Status()
        run(stat)
        return stat.code

    bad = LabeledArray.invalid()
    assert code(lambda s: isel(potential, "theta", 3, s)) == 0
    assert [code(lambda s, d=d, i=i: isel(potential, d, i, s)) for d, i in (("theta", 0), ("theta", 4), ("phi", 1))] == [1, 1, 1]
    assert [code(lambda s, d=d, v=v: sel(potential, d, v, None, s)) for d, v in (("radius", 0.3), ("theta", 1), ("phi", 1))] == [2, 2, 2]
    assert [code(lambda s, d=d: mean(potential, d, s)) for d in ("theta", "phi")] == [0, 2]
    assert code(lambda s: mean(bad, "x", s)) == 2 and code(lambda s: add(bad, potential, s)) == 1
    assert code(lambda s: add(potential, data_array(spark, [1.0], ["theta"]), s)) == 3
    assert code(lambda s: potential.set_coord("phi", [1], s)) == 1 and code(lambda s: potential.set_coord("theta", [1], s)) == 1
    assert code(lambda s: Dataset().get("x", s)) == 2
    kept = Slot(potential)
    assert code(lambda s: add_into(potential, data_array(spark, [1.0], ["theta"]), kept, s)) == 3 and kept.array is potential
    with pytest.raises(LabelGridError):
        isel(potential, "theta", 9, Status(strict=True))
    assert bad.size() == 0 and bad.rank() == -1 and bad.dim_index("x") == 0 and not (bad + potential).valid()


def test_selection_of_a_table_array_reaches_the_scan(spark):
    lines = catalog.sel_then_mean(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (scan,) = [k for k, line in enumerate(lines) if "Relation" in line]  # one scan of the facts
    assert "Filter" in lines[scan - 1] and "(year(" in lines[scan - 1] and " = 199" in lines[scan - 1]
    frame = spark.createDataFrame([(r, y, float(10 * r + y)) for r, y in itertools.product((1, 2, 3), (7, 8))], "r int, y int, v double")
    from pyspark.sql import functions as F

    from labelgrid import variables_from_table

    both = variables_from_table(frame, ["r", "y"], {"a": F.sum("v"), "b": F.count("*")})
    a, b = both.get("a").sel("y", 8), both.get("b").sel("y", 8)
    assert a._frame is b._frame and linear(a + b) == [19, 29, 39]  # still columns of one frame
    assert linear(a.isel("r", 2)) == [28]


# -- files, byte by byte --------------------------------------------------------


def text(t):
    return struct.pack(">I", len(t)) + t.encode() + bytes(-len(t) % 4)


def header(version, records, dims, variables):
    """``variables``: (name, dimension numbers, attributes as bytes, type, vsize); returns the bytes and where data begin."""
    def made(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", records) + struct.pack(">II", 10, len(dims))
        for name, n in dims:
            out += text(name) + struct.pack(">I", n)
        out += struct.pack(">IIII", 0, 0, 11, len(variables))
        for (name, ids, attrs, kind, size), at in zip(variables, begins):
            out += text(name) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + attrs + struct.pack(">II", kind, size)
            out += struct.pack(">I" if version == 1 else ">Q", at)
        return out

    at = len(made([0] * len(variables)))
    begins = []
    for v in variables:
        begins.append(at)
        at += v[4]
    return made(begins), begins


NONE = struct.pack(">II", 0, 0)
UNITS = struct.pack(">II", 12, 1) + text("units") + struct.pack(">I", 2) + text("V")


def test_files_hold_the_formats_bytes(spark, tmp_path):
    head, _ = header(1, 0, [("radius", 2), ("theta", 3)], [("radius", [0], NONE, 6, 16), ("potential", [1, 0], UNITS, 6, 48)])
    whole = head + struct.pack(">8d", 0.25, 0.75, 11, 12, 21, 22, 31, 32)
    path = str(tmp_path / "field.nc")
    values = [[11, 21, 31], [12, 22, 32]]
    write_netcdf(path, data_array(spark, values, ["radius", "theta"], "potential").set_coord("radius", [0.25, 0.75]).set_attr("units", "V"), Status(strict=True))
    with open(path, "rb") as f:
        assert f.read() == whole
    assert [p.name for p in tmp_path.iterdir()] == ["field.nc"]
    hand = str(tmp_path / "hand.nc")
    with open(hand, "wb") as f:
        f.write(whole)
    got = read_netcdf(spark, hand, "potential", Status(strict=True))
    assert (got.dims, got.shape, got.attrs) == (("radius", "theta"), (2, 3), {}) and linear(got) == [11, 12, 21, 22, 31, 32]
    assert [r.coord for r in got.coords["radius"].orderBy("idx").collect()] == [0.25, 0.75]
    short = str(tmp_path / "short.nc")
    with open(short, "wb") as f:
        f.write(whole[:-8])
    stat = Status()
    assert not read_netcdf(spark, short, "potential", stat).valid() and stat.code == 1


def test_reads_records_types_and_the_second_version(spark, tmp_path):
    kinds = [(1, ">i1", 4), (3, ">i2", 4), (4, ">i4", 8), (5, ">f4", 8), (6, ">f8", 16)]
    variables = [(f"v{k}", [0, 1], NONE, k, size) for k, _, size in kinds]
    for version in (1, 2):
        head, begins = header(version, 3, [("time", 0), ("x", 2)], variables)
        body = b""
        for t in range(3):
            for k, code, size in kinds:
                body += np.array([10 * t + k, -t], code).tobytes().ljust(size, b"\0")
        path = str(tmp_path / f"records{version}.nc")
        with open(path, "wb") as f:
            f.write(head + body)
        for k, _, _ in kinds:
            got = read_netcdf(spark, path, f"v{k}", Status(strict=True))
            assert (got.dims, got.shape) == (("x", "time"), (2, 3)) and linear(got) == [k, 0, 10 + k, -1, 20 + k, -2]
    head, _ = header(1, 0, [(d, 1) for d in "abcde"], [("deep", [0, 1, 2, 3, 4], NONE, 6, 8), ("letters", [0], NONE, 2, 4), ("one", [], NONE, 6, 8)])
    path = str(tmp_path / "deep.nc")
    with open(path, "wb") as f:
        f.write(head + struct.pack(">d", 1) + b"a\0\0\0" + struct.pack(">d", 4.5))
    codes = []
    for name in ("deep", "letters", "absent", "one"):
        stat = Status()
        read_netcdf(spark, path, name, stat)
        codes.append(stat.code)
    assert codes == [1, 1, 1, 0] and linear(read_netcdf(spark, path, "one")) == [4.5]


def test_large_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    from labelgrid.sources import netcdf

    monkeypatch.setattr(netcdf, "SLAB_CELLS", 50)
    values = np.random.default_rng(1).random((7, 5, 11))
    path = str(tmp_path / "parts.nc")
    array = data_array(spark, values, ["a", "b", "c"], "v").set_coord("c", list(range(11)))
    write_netcdf(path, array, Status(strict=True))
    got = read_netcdf(spark, path, "v", Status(strict=True))
    assert np.array_equal(grid(got), values) and got.cells.rdd.getNumPartitions() == 8
    stat = Status()  # a cell short: refused, and the file stays as it was
    write_netcdf(path, LabeledArray(array.meta, array.cells.where("d1 > 1 or d2 > 1 or d3 > 1")), stat)
    assert stat.code == 1 and np.array_equal(grid(read_netcdf(spark, path, "v")), values) and len(list(tmp_path.iterdir())) == 1
