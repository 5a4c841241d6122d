"""DataFrame operators: chunking, extraction, entities, spans, geometry, scoring, retrieval, audit."""
