"""NetCDF classic files and the Parquet store."""
