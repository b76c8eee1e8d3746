"""One module per group of operators; each takes and returns DataFrames."""
