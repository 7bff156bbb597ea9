"""DataFrame operators: mapping, casting, inference, keys, ledger, checks."""
