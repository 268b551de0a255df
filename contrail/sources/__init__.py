"""Readers and writers: message shapes, partitioned tables, topics, exports."""
