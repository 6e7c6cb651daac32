"""Statement-ledger analytics on Spark DataFrames."""
