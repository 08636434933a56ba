"""cairnlight: a Spark-first engine for evidence-centred literature analytics."""
