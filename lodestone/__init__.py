"""lodestone: faceted search, relevance and OLAP operators as PySpark DataFrame plans."""
