"""Part of querent: operators."""
