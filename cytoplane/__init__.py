"""Single-cell analytics on Spark: sparse counts, cell and gene tables, sums, tests, graphs and maps as DataFrames."""
