"""Table-to-table operators: functions from DataFrames to DataFrames."""
