"""Search and analytics over Spark tables, declared as DataFrame plans."""
