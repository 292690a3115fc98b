"""Entry points: the registered queries and spark-submit jobs."""
