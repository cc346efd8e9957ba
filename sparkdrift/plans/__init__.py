"""Jobs composed from operators: ingestion, training, drift checks."""
