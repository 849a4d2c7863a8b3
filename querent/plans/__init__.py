"""Part of querent: plans."""
