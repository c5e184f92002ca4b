"""DataFrame-to-DataFrame operators: profiling, validation, screening, run-log and lineage work."""
