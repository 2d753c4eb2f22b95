"""Metadata profiling of messy file collections, expressed as Spark jobs."""
