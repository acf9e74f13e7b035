"""Sources (raw readers, test-data adapters) and sinks."""
