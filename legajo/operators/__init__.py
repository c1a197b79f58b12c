"""DataFrame operators: retrieval, fusion, graph, chunking."""
