"""graphloom: knowledge-graph analytics expressed as Spark DataFrame plans."""
