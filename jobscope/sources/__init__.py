"""Sources and sinks: schemas and aliases, CSV/Parquet/wide readers, the per-cluster
registry, test-table adapters, result and metric tables."""
