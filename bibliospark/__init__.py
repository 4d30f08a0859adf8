"""Set-at-a-time analytics over a research-paper corpus, on Spark DataFrames."""
