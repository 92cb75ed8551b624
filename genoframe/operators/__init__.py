"""genoframe operators."""
