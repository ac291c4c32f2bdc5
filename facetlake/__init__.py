"""facetlake: faceted document search and library analytics as Spark DataFrame jobs."""
