"""Transitions and decisions: DataFrame in, DataFrame out, with an explicit as_of."""
