"""graphloom: similarity-graph clustering and corpus preparation as Spark jobs."""
