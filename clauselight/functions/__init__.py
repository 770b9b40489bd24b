"""Column expressions and row-local transforms. Nothing here shuffles."""
