"""Files that keep arriving: incremental append and upsert."""
