"""Tables, JSON payloads, datasets and benchmark suites as DataFrames; sinks."""
