"""genoframe sources."""
