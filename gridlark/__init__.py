"""gridlark: detection analytics and training-data operators as Spark jobs."""
