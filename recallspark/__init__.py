"""Memory analytics on Spark: notes, entities, dated events and the graph that links them."""
