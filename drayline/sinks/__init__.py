"""Writing tables: snapshots on a file system, and databases over JDBC."""
