"""Forensic analysis of authentication logs as Spark DataFrame jobs."""
