"""secstream.sources."""
