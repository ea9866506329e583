"""codeloam: analytics over source-code and text corpora, on Spark DataFrames."""
