"""DataFrame operators: each takes and returns DataFrames or Columns and runs nothing by itself."""
