"""Column-level functions: distance transforms, range predicates, similarities."""
