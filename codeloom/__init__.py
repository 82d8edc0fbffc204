"""Structure analytics over files, symbols and directed edges, as Spark DataFrames."""
