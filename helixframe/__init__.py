"""helixframe: expression, variant and annotation analytics as Spark DataFrame jobs."""
