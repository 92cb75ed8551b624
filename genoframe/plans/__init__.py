"""genoframe plans."""
