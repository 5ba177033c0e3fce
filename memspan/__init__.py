"""memspan: exact-match analytics over text and nucleotide columns, built on Spark DataFrames."""
