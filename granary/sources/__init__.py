"""Readers and writers: declared tables over Parquet, in-memory relations, logs, generators and exports."""
