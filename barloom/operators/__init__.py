"""DataFrame operators: rolling frames, recurrences, ranks, selection, upsert, metrics."""
