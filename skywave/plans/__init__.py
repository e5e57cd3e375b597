"""Query catalogue over the telemetry relations."""
