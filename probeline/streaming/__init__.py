"""Windows of probes over a stream."""
