"""Part of querent: streaming."""
