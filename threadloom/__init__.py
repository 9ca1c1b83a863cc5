"""threadloom: conversation archives, hybrid retrieval and corpus preparation on Spark."""
