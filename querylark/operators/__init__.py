"""Search and the operations on indexes."""
