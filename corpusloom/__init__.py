"""corpusloom: a Spark-native engine for evidence synthesis and corpus analysis."""
