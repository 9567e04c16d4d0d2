"""Column-level functions: pure ``Column -> Column`` helpers, no shuffles."""
