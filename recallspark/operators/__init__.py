"""Relational, graph, vector, text and time operators: DataFrame in, DataFrame out."""
