"""gridloom: analytics over directed, labelled dependency graphs, built on Spark DataFrames."""
