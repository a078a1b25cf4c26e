"""Column-expression helpers (money, tokens, bands)."""
