"""Document-corpus dataflow operators for Spark: plain functions over DataFrames and Columns."""
