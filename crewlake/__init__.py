"""crewlake: workforce-operations analytics written as PySpark DataFrame jobs."""
