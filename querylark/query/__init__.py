"""The query language: text to clauses, on the driver."""
