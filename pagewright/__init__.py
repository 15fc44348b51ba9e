"""Search, index building and index audits over collections of pages, as Spark DataFrames."""
