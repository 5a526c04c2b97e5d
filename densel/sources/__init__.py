"""Sources and sinks: term tables, vectors, weights, metrics JSON."""
