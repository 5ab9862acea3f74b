"""textloom: document enrichment as DataFrame -> DataFrame stages on Spark."""
