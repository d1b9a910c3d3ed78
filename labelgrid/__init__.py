"""labelgrid: dense labelled float64 arrays as Spark DataFrames.

An array is a small driver-side description (names, extents, coordinates,
attributes) plus a DataFrame of cells.  Every computation is an ordinary
DataFrame plan, so Catalyst chooses the physical strategy.
"""

from labelgrid.array import LabeledArray
from labelgrid.dataset import Dataset
from labelgrid.functions.construct import data_array, from_array_column, from_table, variables_from_table
from labelgrid.operators.align import add, add_into
from labelgrid.operators.reduce import mean, mean_into
from labelgrid.operators.select import isel, sel
from labelgrid.sources.netcdf import read_netcdf, write_netcdf
from labelgrid.sources.store import read_store, write_store
from labelgrid.status import EINVAL, ENOTFOUND, ESHAPE, SUCCESS, LabelGridError, Slot, Status

__all__ = [
    "EINVAL", "ENOTFOUND", "ESHAPE", "SUCCESS", "Dataset", "LabelGridError", "LabeledArray", "Slot", "Status",
    "add", "add_into", "data_array", "from_array_column", "from_table", "isel", "mean", "mean_into", "read_netcdf",
    "read_store", "sel", "variables_from_table", "write_netcdf", "write_store",
]
