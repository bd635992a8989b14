"""tessera: similarity scoring of transactions, and training-data operators, on Spark DataFrames."""
