"""DataFrame operators: filters, retrieval, ranking, graph, history, consolidation, synthesis."""
