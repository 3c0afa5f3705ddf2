"""Source-language front ends: everything here runs inside Spark's Python workers."""
