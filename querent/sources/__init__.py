"""Part of querent: sources."""
