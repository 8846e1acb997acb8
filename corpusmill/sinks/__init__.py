"""Writers of datasets, splits, ledgers, results and events."""
