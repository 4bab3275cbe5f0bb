"""Code-graph analytics on Spark: extraction, ranking, search and impact as DataFrame plans."""
