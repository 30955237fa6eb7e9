"""DataFrame operators: metrics, scores, weights, aggregates, audits and segment planning."""
