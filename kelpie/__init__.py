"""kelpie: retrieval, graph and corpus analytics as Spark jobs."""
