"""Every operator applied to the test tables, each with an independent SQL statement of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid import (
    Dataset, LabeledArray, Slot, Status, add, add_into, data_array, from_array_column, from_table, isel, mean, mean_into,
    read_netcdf, read_store, sel, variables_from_table, write_netcdf, write_store,
)
from labelgrid.plans.materialize import shared_dir
from labelgrid.sources import classic, netcdf

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a function under its name, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


# -- source arrays and their SQL --------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FACTS = {
    "returnflag": "l_returnflag", "linestatus": "l_linestatus", "year": "year(l_shipdate)", "linenumber": "l_linenumber",
}


def quantity(spark, sf_dir, dims=tuple(FACTS), name="quantity") -> LabeledArray:
    """Q: summed l_quantity over any of its dimensions."""
    lines = table(spark, sf_dir, "lineitem").select(*[F.expr(FACTS[d]).alias(d) for d in dims], "l_quantity")
    return from_table(lines, list(dims), F.sum("l_quantity"), name=name)


def grid_sql(name: str, source: str, dims: dict[str, str], value: str) -> str:
    """One CTE of an array: index = dense rank of the key."""
    ranks = ", ".join(f'CAST(dense_rank() OVER (ORDER BY {e}) AS INTEGER) AS "{d}"' for d, e in dims.items())
    keys = ", ".join(f'"{d}"' for d in dims) or "1"
    lead = ", ".join(f'"{d}"' for d in dims)
    by = f" GROUP BY {keys}" if dims else ""
    return f'{name} AS (SELECT {lead + ", " if lead else ""}CAST({value} AS DOUBLE) AS value FROM (SELECT {ranks + ", " if ranks else ""}* FROM {source}){by})'


def q_sql(*dims: str, name: str = "q") -> str:
    return grid_sql(name, "lineitem", {d: FACTS[d] for d in (dims or FACTS)}, "sum(l_quantity)")


def orders_count(spark, sf_dir) -> LabeledArray:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return from_table(rows, ["status", "priority", "year"], F.count("*"), name="orders")


ORD = grid_sql("o", "orders", {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "year(o_orderdate)"}, "count(*)")


def hours(spark, sf_dir) -> LabeledArray:
    rows = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    return from_table(rows, ["event_type", "hour"], F.count("*"), name="events")


EVT = grid_sql("e", "events", {"event_type": "event_type", "hour": "hour(ts)"}, "count(*)")


def embeddings(spark, sf_dir) -> LabeledArray:
    rows = table(spark, sf_dir, "embeddings")
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    return from_array_column(rows, "vec_id", "embedding", 64, n, name="embedding")


EMB = "m AS (SELECT CAST(i AS INTEGER) AS component, CAST(vec_id + 1 AS INTEGER) AS vec, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"


def status_row(spark, *codes) -> DataFrame:
    names = ["status"] if len(codes) == 1 else [f"status{k}" for k in range(1, len(codes) + 1)]
    return spark.createDataFrame([tuple(int(c) for c in codes)], ", ".join(f"{n} int" for n in names))


def status_sql(*codes) -> str:
    names = ["status"] if len(codes) == 1 else [f"status{k}" for k in range(1, len(codes) + 1)]
    return "SELECT " + ", ".join(f"CAST({c} AS INTEGER) AS {n}" for c, n in zip(codes, names))


def cells_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def ordered_avg(dim: str) -> str:
    return f'list_reduce(list(value ORDER BY "{dim}"), lambda a, b: a + b) / count(*)'


# -- constructors -------------------------------------------------------------


@query(cells_sql(q_sql(name="q"), "SELECT sum(value) AS value FROM q"))
def construct_scalar(spark, sf_dir):
    total = table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity")).first()[0]
    return data_array(spark, total, (), "total").to_table()


def _constructor(rank: int):
    dims = tuple(FACTS)[4 - rank :]

    def run(spark, sf_dir):
        return quantity(spark, sf_dir, dims).to_table()

    run.__name__ = f"construct_rank{rank}"
    query(cells_sql(q_sql(*dims), "SELECT * FROM q"))(run)


for _rank in (1, 2, 3, 4):
    _constructor(_rank)


@query("SELECT CAST(b AS INTEGER) AS radius, CAST(a AS INTEGER) AS theta, CAST(10 * a + b AS DOUBLE) AS value FROM range(1, 4) x(a), range(1, 3) y(b)")
def construct_nested(spark, sf_dir):
    return data_array(spark, [[11, 21, 31], [12, 22, 32]], ["radius", "theta "], "potential").to_table()


@query(status_sql(0, 0, 0))
def construct_bad_dims(spark, sf_dir):
    """A wrong count of dimensions, a repeated one, and rank 5: all invalid (0), no status."""
    made = [data_array(spark, [1.0, 2.0], ["a", "b"]), data_array(spark, [[1.0]], ["a", "a "]), data_array(spark, [[[[[1.0]]]]], list("abcde"))]
    return status_row(spark, *[a.valid() for a in made])


@query(cells_sql(EMB, "SELECT * FROM m"))
def construct_from_array_column(spark, sf_dir):
    return embeddings(spark, sf_dir).to_table()


@query(cells_sql(
    grid_sql("g", "events", {"event_type": "event_type", "day": "CAST(ts AS DATE)", "hour": "hour(ts)"}, "count(*)"),
    "SELECT event_type, day, hour, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT event_type FROM g) CROSS JOIN (SELECT DISTINCT day FROM g) CROSS JOIN (SELECT DISTINCT hour FROM g) LEFT JOIN g USING (event_type, day, hour)"))
def construct_filled_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    return from_table(rows, ["event_type", "day", "hour"], F.count("*"), fill=0).to_table()


def _filled(name, source, dims):
    def run(spark, sf_dir):
        return from_table(table(spark, sf_dir, source).select(*[F.col(c).alias(d) for d, c in dims.items()]), list(dims), F.count("*"), fill=0).to_table()

    run.__name__ = name
    a, b = dims
    query(cells_sql(grid_sql("g", source, dims, "count(*)"), f"SELECT {a}, {b}, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT {a} FROM g) CROSS JOIN (SELECT DISTINCT {b} FROM g) LEFT JOIN g USING ({a}, {b})"))(run)


_filled("construct_filled_parts", "part", {"brand": "p_brand", "kind": "p_type"})
_filled("construct_filled_customers", "customer", {"segment": "c_mktsegment", "nation": "c_nationkey"})

# -- metadata -----------------------------------------------------------------


@query(cells_sql(q_sql(), "SELECT CAST(1 + (returnflag - 1) + 3 * (linestatus - 1) + 6 * (year - 1) + 42 * (linenumber - 1) AS BIGINT) AS lin, value FROM q"))
def array_layout(spark, sf_dir):
    return quantity(spark, sf_dir).values_df()


@query("SELECT CAST(1 AS INTEGER) AS shallow, CAST(count(*) = 294 AS INTEGER) AS deep, CAST(0 AS INTEGER) AS none FROM (SELECT DISTINCT l_returnflag, l_linestatus, year(l_shipdate), l_linenumber FROM lineitem)")
def array_valid(spark, sf_dir):
    q = quantity(spark, sf_dir)
    return spark.createDataFrame([(int(q.valid()), int(q.valid(deep=True)), int(LabeledArray.invalid().valid()))], "shallow int, deep int, none int")


@query("SELECT CAST(count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) * count(DISTINCT year(l_shipdate)) * count(DISTINCT l_linenumber) AS BIGINT) AS size, CAST(4 AS INTEGER) AS rank, CAST(0 AS BIGINT) AS no_size, CAST(-1 AS INTEGER) AS no_rank FROM lineitem")
def array_size_rank(spark, sf_dir):
    q, none = quantity(spark, sf_dir), LabeledArray.invalid()
    return spark.createDataFrame([(q.size(), q.rank(), none.size(), none.rank())], "size long, rank int, no_size long, no_rank int")


@query(status_sql(3, 3, 0, 0))
def dim_index_lookup(spark, sf_dir):
    q = quantity(spark, sf_dir)
    return status_row(spark, q.dim_index("year"), q.dim_index("year  "), q.dim_index("Year"), q.dim_index(" year"))


@query("SELECT CAST(i AS INTEGER) AS idx, CAST(10 * i AS DOUBLE) AS coord FROM range(1, 8) t(i)")
def set_coord_replace(spark, sf_dir):
    return quantity(spark, sf_dir).set_coord("year", range(1, 8)).set_coord("year ", [10.0 * k for k in range(1, 8)]).coords["year"]


@query(status_sql(1, 1))
def set_coord_bad_length_status(spark, sf_dir):
    q, short, none = quantity(spark, sf_dir), Status(), Status()
    q.set_coord("year", [1.0], short)
    q.set_coord("month", [1.0], none)
    return status_row(spark, short.code, none.code)


@query("SELECT * FROM (VALUES (1, 'units', 'pieces'), (2, 'source', 'lineitem')) t(pos, name, value)")
def set_attr_upsert(spark, sf_dir):
    attrs = quantity(spark, sf_dir).set_attr("units", "V").set_attr("source", "lineitem").set_attr("units ", "pieces").attrs
    return spark.createDataFrame([(k, *kv) for k, kv in enumerate(attrs.items(), 1)], "pos int, name string, value string")


# -- isel ---------------------------------------------------------------------


@query(cells_sql(q_sql(), "SELECT linestatus, year, linenumber, value FROM q WHERE returnflag = 1"))
def isel_first(spark, sf_dir):
    return isel(quantity(spark, sf_dir), "returnflag", 1).to_table()


@query(cells_sql(q_sql(), "SELECT returnflag, linestatus, linenumber, value FROM q WHERE year = 4"))
def isel_middle(spark, sf_dir):
    return quantity(spark, sf_dir).isel("year", 4).to_table()


@query(cells_sql(q_sql(), "SELECT returnflag, linestatus, year, value FROM q WHERE linenumber = 7"))
def isel_last(spark, sf_dir):
    return quantity(spark, sf_dir).isel("linenumber", 7).to_table()


@query(cells_sql(q_sql("year"), "SELECT value FROM q WHERE year = 3"))
def isel_to_scalar(spark, sf_dir):
    return quantity(spark, sf_dir, ("year",)).isel("year", 3).to_table()


@query(cells_sql(q_sql(), "SELECT returnflag, linenumber, value FROM q WHERE linestatus = 2 AND year = 5"))
def isel_chain(spark, sf_dir):
    return quantity(spark, sf_dir).isel("year", 5).isel("linestatus", 2).to_table()


@query(cells_sql(EMB, "SELECT vec, value FROM m WHERE component = 10"))
def isel_array_column(spark, sf_dir):
    return embeddings(spark, sf_dir).isel("component", 10).to_table()


@query(status_sql(1, 1, 1))
def isel_bounds_status(spark, sf_dir):
    e, got = hours(spark, sf_dir), []
    for k in (0, 25, -1):
        stat = Status()
        e.isel("hour", k, stat)
        got.append(stat.code)
    return status_row(spark, *got)


@query(status_sql(1, 1))
def isel_missing_dim_status(spark, sf_dir):
    stat, none = Status(), Status()
    isel(hours(spark, sf_dir), "minute", 1, stat)
    isel(LabeledArray.invalid(), "hour", 1, none)
    return status_row(spark, stat.code, none.code)


# -- sel ----------------------------------------------------------------------

_YEAR = "SELECT returnflag, linestatus, linenumber, value FROM q WHERE year = "


def _year_at(order: str) -> str:
    return f"(SELECT i FROM (SELECT y, CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS i FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)) ORDER BY {order}, i LIMIT 1)"


@query(cells_sql(q_sql(), _YEAR + _year_at("abs(y - 1998)")))
def sel_exact(spark, sf_dir):
    return sel(quantity(spark, sf_dir), "year", 1998.0).to_table()


@query(cells_sql(EVT, "SELECT event_type, value FROM e WHERE hour = (SELECT CAST(count(DISTINCT hour(ts)) AS INTEGER) FROM events WHERE hour(ts) <= 13)"))
def sel_exact_hour(spark, sf_dir):
    return hours(spark, sf_dir).sel("hour", 13).to_table()


@query(status_sql(2, 2))
def sel_exact_miss_status(spark, sf_dir):
    q, miss, nan = quantity(spark, sf_dir), Status(), Status()
    q.sel("year", 1997.4, stat=miss)
    q.sel("year", float("nan"), stat=nan)
    return status_row(spark, miss.code, nan.code)


@query(cells_sql(q_sql(), _YEAR + _year_at("abs(y - 1997.4)")))
def sel_nearest(spark, sf_dir):
    return quantity(spark, sf_dir).sel("year", 1997.4, "nearest").to_table()


@query(cells_sql(q_sql(), _YEAR + _year_at("abs(y - 1997.5)")))
def sel_nearest_tie(spark, sf_dir):
    return quantity(spark, sf_dir).sel("year", 1997.5, "nearest").to_table()


@query(cells_sql(q_sql(), _YEAR + _year_at("abs(y - 1900)")))
def sel_nearest_outside(spark, sf_dir):
    return quantity(spark, sf_dir).sel("year", 1900, "nearest").to_table()


@query(cells_sql(q_sql(), _YEAR + "6"))
def sel_nearest_unsorted(spark, sf_dir):
    return quantity(spark, sf_dir).set_coord("year", [9.0, float("nan"), 2.0, 9.0, 4.5, 3.0, 3.0]).sel("year", 3.2, "nearest").to_table()


@query(status_sql(2, 2))
def sel_no_coord_status(spark, sf_dir):
    q, text, none = quantity(spark, sf_dir), Status(), Status()
    q.sel("returnflag", 1.0, "nearest", text)
    q.sel("month", 1.0, "nearest", none)
    return status_row(spark, text.code, none.code)


@query(status_sql(2))
def sel_unknown_method_is_exact(spark, sf_dir):
    stat = Status()
    quantity(spark, sf_dir).sel("year", 1997.4, "pad", stat)
    return status_row(spark, stat.code)


# -- mean ---------------------------------------------------------------------


def _mean(name, dim):
    kept = ", ".join(d for d in FACTS if d != dim)

    def run(spark, sf_dir):
        return mean(quantity(spark, sf_dir), dim).to_table()

    run.__name__ = name
    query(cells_sql(q_sql(), f"SELECT {kept}, avg(value) AS value FROM q GROUP BY {kept}"))(run)


_mean("mean_first", "returnflag")
_mean("mean_middle", "year")
_mean("mean_last", "linenumber")


@query(cells_sql(q_sql("year"), "SELECT avg(value) AS value FROM q"))
def mean_to_scalar(spark, sf_dir):
    return quantity(spark, sf_dir, ("year",)).mean("year").to_table()


@query(cells_sql(q_sql(), f"SELECT returnflag, linestatus, {ordered_avg('linenumber')} AS value FROM (SELECT returnflag, linestatus, linenumber, {ordered_avg('year')} AS value FROM q GROUP BY ALL) GROUP BY ALL"))
def mean_chain(spark, sf_dir):
    return quantity(spark, sf_dir).mean("year", ordered=True).mean("linenumber", ordered=True).to_table()


@query(cells_sql(EMB, f"SELECT component, {ordered_avg('vec')} AS value FROM m GROUP BY component"))
def mean_ordered(spark, sf_dir):
    return embeddings(spark, sf_dir).mean("vec", ordered=True).to_table()


@query(cells_sql(EMB, f"SELECT vec, {ordered_avg('component')} AS value FROM m GROUP BY vec"))
def mean_array_column(spark, sf_dir):
    return embeddings(spark, sf_dir).mean("component").to_table()


@query(status_sql(2, 2, 2, 1))
def mean_missing_dim_status(spark, sf_dir):
    got = []
    for array, dim in ((quantity(spark, sf_dir, ("year",)), "month"), (data_array(spark, 1.0), "x"), (LabeledArray.invalid(), "x"), (data_array(spark, [], ["x"]), "x")):
        stat = Status()
        mean(array, dim, stat)
        got.append(stat.code)
    return status_row(spark, *got)


@query(cells_sql(q_sql(), "SELECT returnflag, linestatus, avg(value) AS value FROM (" + _YEAR + _year_at("abs(y - 1997.4)") + ") GROUP BY returnflag, linestatus"))
def sel_then_mean(spark, sf_dir):
    """The flagship: nearest label, then a mean."""
    return quantity(spark, sf_dir).sel("year", 1997.4, method="nearest").mean("linenumber").to_table()


# -- add ----------------------------------------------------------------------

_ALL = ", ".join(FACTS)


@query(cells_sql(q_sql() + ", " + grid_sql("p", "lineitem", FACTS, "count(*)"), f"SELECT {_ALL}, q.value + p.value AS value FROM q JOIN p USING ({_ALL})"))
def add_same_layout(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(d) for d, e in FACTS.items()], "l_quantity")
    both = variables_from_table(lines, list(FACTS), {"quantity": F.sum("l_quantity"), "lines": F.count("*")})
    return (both.get("quantity") + both.get("lines")).to_table()


@query(cells_sql(q_sql(), f"SELECT {_ALL}, value + value AS value FROM q"))
def add_separate_frames(spark, sf_dir):
    return (quantity(spark, sf_dir).chunked() + quantity(spark, sf_dir).chunked()).to_table()


@query(cells_sql(q_sql("year", "linenumber"), "SELECT year, linenumber, value + value AS value FROM q"))
def add_permuted(spark, sf_dir):
    return (quantity(spark, sf_dir, ("year", "linenumber")) + quantity(spark, sf_dir, ("linenumber", "year"))).to_table()


@query(cells_sql(q_sql() + ", " + q_sql("year", name="y"), f"SELECT {_ALL}, q.value + y.value AS value FROM q JOIN y USING (year)"))
def add_broadcast_right(spark, sf_dir):
    return (quantity(spark, sf_dir) + quantity(spark, sf_dir, ("year",))).to_table()


@query(cells_sql(q_sql() + ", " + q_sql("year", name="y"), "SELECT year, returnflag, linestatus, linenumber, q.value + y.value AS value FROM q JOIN y USING (year)"))
def add_broadcast_left(spark, sf_dir):
    return (quantity(spark, sf_dir, ("year",)) + quantity(spark, sf_dir)).to_table()


@query(cells_sql(q_sql("returnflag", "year") + ", " + ORD, "SELECT returnflag, q.year, status, priority, q.value + o.value AS value FROM q JOIN o ON q.year = o.year"))
def add_partial_overlap(spark, sf_dir):
    return (quantity(spark, sf_dir, ("returnflag", "year")) + orders_count(spark, sf_dir)).to_table()


@query(cells_sql(q_sql("returnflag", "linestatus") + ", " + EVT, "SELECT returnflag, linestatus, event_type, hour, q.value + e.value AS value FROM q CROSS JOIN e"))
def add_outer(spark, sf_dir):
    return (quantity(spark, sf_dir, ("returnflag", "linestatus")) + hours(spark, sf_dir)).to_table()


@query(cells_sql(q_sql("year"), "SELECT year, value + 0.5 AS value FROM q"))
def add_scalar(spark, sf_dir):
    return (quantity(spark, sf_dir, ("year",)) + data_array(spark, 0.5)).to_table()


@query("SELECT CAST(3.75 AS DOUBLE) AS value")
def add_two_scalars(spark, sf_dir):
    return (data_array(spark, 1.5) + data_array(spark, 2.25)).to_table()


@query(cells_sql(q_sql(), f"SELECT {_ALL}, CAST(k AS INTEGER) AS scenario, value + 100 * k AS value FROM q CROSS JOIN range(1, 4) t(k)"))
def add_rank5(spark, sf_dir):
    return (quantity(spark, sf_dir) + data_array(spark, [100.0, 200.0, 300.0], ["scenario"])).to_table()


@query(status_sql(3, 1))
def add_shape_mismatch_status(spark, sf_dir):
    stat, none, q = Status(), Status(), quantity(spark, sf_dir, ("year",))
    add(q, data_array(spark, [1.0, 2.0], ["year"]), stat)
    add(q, LabeledArray.invalid(), none)
    return status_row(spark, stat.code, none.code)


@query(status_sql(3))
def add_extent_one_status(spark, sf_dir):
    stat = Status()
    add(quantity(spark, sf_dir, ("year",)), data_array(spark, [1.0], ["year"]), stat)
    return status_row(spark, stat.code)


# -- destinations -------------------------------------------------------------


def _described(spark, array: LabeledArray) -> DataFrame:
    row = (array.name, ",".join(array.dims), ",".join(array.coords), ",".join(f"{k}={v}" for k, v in array.attrs.items()))
    return spark.createDataFrame([row], "name string, dims string, coords string, attrs string")


@query("SELECT 'quantity' AS name, 'year' AS dims, 'year' AS coords, 'units=pieces' AS attrs")
def mean_into_replaces_metadata(spark, sf_dir):
    out = Slot(data_array(spark, [1.0, 2.0], ["x"], "old").set_coord("x", [0, 1]).set_attr("old", "1"))
    mean_into(quantity(spark, sf_dir, ("returnflag", "year")).set_attr("units", "pieces"), "returnflag", out)
    return _described(spark, out.array)


@query("SELECT 'quantity' AS name, 'year' AS dims, 'x' AS coords, 'old=1' AS attrs")
def add_into_keeps_stale_metadata(spark, sf_dir):
    q, out = quantity(spark, sf_dir, ("year",)), Slot(data_array(spark, [1.0, 2.0], ["x"], "old").set_coord("x", [0, 1]).set_attr("old", "1"))
    add_into(q, q, out)
    return _described(spark, out.array)


@query("SELECT CAST(i AS INTEGER) AS x, CAST(i AS DOUBLE) AS value, CAST(2 AS INTEGER) AS mean_status, CAST(3 AS INTEGER) AS add_status FROM range(1, 3) t(i)")
def into_failure_keeps_destination(spark, sf_dir):
    q, out, first, second = quantity(spark, sf_dir, ("year",)), Slot(data_array(spark, [1.0, 2.0], ["x"])), Status(), Status()
    mean_into(q, "month", out, first)
    add_into(q, data_array(spark, [1.0], ["year"]), out, second)
    return out.array.to_table().select("*", F.lit(first.code).alias("mean_status"), F.lit(second.code).alias("add_status"))


# -- datasets -----------------------------------------------------------------


def _dataset(spark, sf_dir) -> Dataset:
    out = Dataset()
    out.set("first", quantity(spark, sf_dir, ("year",)))
    out.set("second", orders_count(spark, sf_dir))
    return out


@query(cells_sql(q_sql("linenumber"), "SELECT linenumber, value FROM q"))
def dataset_set_replace(spark, sf_dir):
    d = _dataset(spark, sf_dir)
    d.set("first ", quantity(spark, sf_dir, ("linenumber",)))
    return d.get("first").to_table()


@query("SELECT 'second' AS name, 'status,priority,year' AS dims, 'year' AS coords, '' AS attrs")
def dataset_get_renames(spark, sf_dir):
    return _described(spark, _dataset(spark, sf_dir).get("second"))


@query(status_sql(1, 0, 2))
def dataset_has_size(spark, sf_dir):
    d = _dataset(spark, sf_dir)
    return status_row(spark, d.has("first"), d.has("third"), d.size())


@query(status_sql(2, 0))
def dataset_get_missing_status(spark, sf_dir):
    stat = Status()
    got = _dataset(spark, sf_dir).get("third", stat)
    return status_row(spark, stat.code, got.valid())


# -- files --------------------------------------------------------------------


def _fixture_file(spark) -> str:
    """potential(theta, radius) with a radius coordinate, in a folder all executors share."""
    import numpy as np

    path = f"{shared_dir(spark)}/labelgrid/fixture-{uuid.uuid4().hex}.nc"
    head, _ = classic.build_header("potential", ["radius", "theta"], [2, 3], {"units": "V"}, ["radius"])
    fs, name = netcdf.locate(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(head + np.array([0.25, 0.75, 11, 12, 21, 22, 31, 32], ">f8").tobytes())
    return path


@query("SELECT CAST(b AS INTEGER) AS radius, CAST(a AS INTEGER) AS theta, CAST(10 * a + b AS DOUBLE) AS value FROM range(1, 4) x(a), range(1, 3) y(b)")
def netcdf_read_fixture(spark, sf_dir):
    return read_netcdf(spark, _fixture_file(spark), "potential").to_table()


@query(cells_sql(q_sql("year", "linenumber"), "SELECT year, linenumber, value FROM q"))
def netcdf_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/labelgrid/roundtrip-{uuid.uuid4().hex}.nc"
    fs, name = netcdf.locate(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    write_netcdf(path, quantity(spark, sf_dir, ("year", "linenumber")), Status(strict=True))
    return read_netcdf(spark, path, "quantity", Status(strict=True)).to_table()


@query("SELECT 'potential' AS name, 'radius,theta' AS dims, 'radius' AS coords, '' AS attrs")
def netcdf_drops_attrs_on_read(spark, sf_dir):
    return _described(spark, read_netcdf(spark, _fixture_file(spark), "potential"))


@query(status_sql(1, 1, 1))
def netcdf_failure_status(spark, sf_dir):
    gone, absent, unnamed = Status(), Status(), Status()
    read_netcdf(spark, f"{shared_dir(spark)}/labelgrid/nowhere.nc", "x", gone)
    read_netcdf(spark, _fixture_file(spark), "x", absent)
    write_netcdf(f"{shared_dir(spark)}/labelgrid/never.nc", data_array(spark, [1.0], ["x"]), unnamed)
    return status_row(spark, gone.code, absent.code, unnamed.code)


@query(cells_sql(q_sql(), _YEAR + "2"))
def store_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/labelgrid/store-{uuid.uuid4().hex}"
    write_store(path, quantity(spark, sf_dir).set_attr("units", "pieces"), partition_by="year")
    return read_store(spark, path).isel("year", 2).to_table()


# -- edge cases ---------------------------------------------------------------

NAN = float("nan")


def _marks(spark, coord) -> LabeledArray:
    """Values 1, 2, .. along x with the given coordinate."""
    return data_array(spark, [float(k) for k in range(1, len(coord) + 1)], ["x"]).set_coord("x", coord)


@query("SELECT CAST(1 AS DOUBLE) AS value")
def edge_nearest_to_nan(spark, sf_dir):
    """A NaN label is nearest to the first index."""
    return _marks(spark, [5.0, 2.0, 9.0]).sel("x", NAN, "nearest").to_table()


@query(status_sql(2, 2, 2))
def edge_no_match_status(spark, sf_dir):
    """Nothing is found: nearest on an empty coordinate, exact NaN, exact on an empty coordinate."""
    found = [Status(), Status(), Status()]
    empty = data_array(spark, [], ["x"]).set_coord("x", [])
    sel(empty, "x", 1.0, "nearest", found[0])
    sel(_marks(spark, [1.0, NAN]), "x", NAN, None, found[1])
    sel(empty, "x", 1.0, None, found[2])
    return status_row(spark, *[s.code for s in found])


@query("SELECT CAST(2 AS DOUBLE) AS value")
def edge_nearest_passes_over_nan(spark, sf_dir):
    return _marks(spark, [NAN, 4.0, NAN]).sel("x", -100.0, "nearest").to_table()


@query("SELECT CAST(2 AS DOUBLE) AS value")
def edge_duplicate_coordinate(spark, sf_dir):
    """The first of equal coordinates, exactly and nearest (a mean of both picks)."""
    marks = _marks(spark, [3.0, 7.0, 7.0, 1.0])
    return ((marks.sel("x", 7.0) + marks.sel("x", 6.9, "nearest")).cells.select((F.col("value") / 2).alias("value")))


@query("SELECT CAST(i AS INTEGER) AS x, CAST(2 * i AS DOUBLE) AS value FROM range(1, 4) t(i)")
def edge_add_ignores_coordinates(spark, sf_dir):
    out = _marks(spark, [1.0, 2.0, 3.0]) + _marks(spark, [30.0, 20.0, 10.0])
    return out.to_table().where(F.lit(not out.coords))


@query(status_sql(0, 1, 0, 1, 0, 1, 1))
def edge_zero_extents(spark, sf_dir):
    """Empty arrays are valid and stay so; only a reduced extent of 0 is an error: sizes, validity and that status."""
    import numpy as np

    wide = data_array(spark, np.zeros((0, 3)), ["a", "b"], "wide")
    stat = Status()
    mean(wide, "a", stat)
    other, both = wide.mean("b"), wide + wide
    return status_row(spark, wide.size(), wide.valid(deep=True), other.size(), other.valid(), both.size(), both.valid(), stat.code)


@query("SELECT CAST(i AS INTEGER) AS radius, CAST(i - 0.5 AS DOUBLE) / 2 AS value, CAST(i - 0.5 AS DOUBLE) / 2 AS coord FROM range(1, 3) t(i)")
def edge_read_coordinate_variable(spark, sf_dir):
    """A coordinate variable read for itself is its own coordinate."""
    got = read_netcdf(spark, _fixture_file(spark), "radius", Status(strict=True))
    coord = got.coords["radius"].withColumnRenamed("idx", "radius")
    return got.to_table().join(coord, "radius")


@query("SELECT CAST(1 AS INTEGER) AS status, CAST(3 AS BIGINT) AS bytes")
def edge_write_refused_keeps_file(spark, sf_dir):
    """An array named like its own coordinate is refused, and the file that was there stays."""
    path = f"{shared_dir(spark)}/labelgrid/kept-{uuid.uuid4().hex}.nc"
    fs, name = netcdf.locate(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(b"old")
    stat = Status()
    write_netcdf(path, data_array(spark, [1.0, 2.0], ["x"], "x").set_coord("x", [0.0, 1.0]), stat)
    return spark.createDataFrame([(stat.code, fs.get_file_info(name).size)], "status int, bytes bigint")


@query(status_sql(0, 0, 2, 0, 1))
def edge_write_empty_slowest(spark, sf_dir):
    """The slowest dimension may be empty: codes of writing and reading, both extents, and whether it is valid."""
    import numpy as np

    path = f"{shared_dir(spark)}/labelgrid/empty-{uuid.uuid4().hex}.nc"
    fs, name = netcdf.locate(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    wrote, read = Status(), Status()
    write_netcdf(path, data_array(spark, np.zeros((2, 0)), ["a", "b"], "none"), wrote)
    got = read_netcdf(spark, path, "none", read)
    return status_row(spark, wrote.code, read.code, *got.shape, got.valid(deep=True))


@query("SELECT 'v' AS name, 'y,x' AS dims, 'y' AS coords, '' AS attrs")
def edge_wide_variable_is_no_coordinate(spark, sf_dir):
    """A variable called like a dimension is its coordinate only if it has that one dimension."""
    import struct

    import numpy as np

    text = lambda t: struct.pack(">I", len(t)) + t.encode().ljust(-(-len(t) // 4) * 4, b"\0")
    var = lambda t, ids, at: text(t) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + struct.pack(">IIIII", 0, 0, 6, 8 * 2 ** len(ids), at)
    head = b"CDF\1" + struct.pack(">III", 0, 10, 2) + text("x") + struct.pack(">I", 2) + text("y") + struct.pack(">I", 2) + struct.pack(">IIII", 0, 0, 11, 3)
    size = len(head) + sum(len(var(t, ids, 0)) for t, ids in (("x", [0, 1]), ("y", [1]), ("v", [0, 1])))
    head += var("x", [0, 1], size) + var("y", [1], size + 32) + var("v", [0, 1], size + 48)
    path = f"{shared_dir(spark)}/labelgrid/wide-{uuid.uuid4().hex}.nc"
    fs, name = netcdf.locate(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(head + np.arange(10, dtype=">f8").tobytes())
    return _described(spark, read_netcdf(spark, path, "v", Status(strict=True)))
