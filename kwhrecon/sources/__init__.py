"""Sources (scans, derived tables) and sinks."""
