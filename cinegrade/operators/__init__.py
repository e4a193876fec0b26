"""DataFrame operators: joins, terms, splits, scores, matching, vectors, components."""
