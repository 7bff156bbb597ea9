"""Reading files, databases and catalogs into DataFrames."""
