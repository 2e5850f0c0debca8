"""Primer and qPCR assay analytics as Spark DataFrame jobs."""
