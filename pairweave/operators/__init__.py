"""Graph construction, clustering, assignment and skew-aware grouping operators."""
