"""Test-log triage and semantic retrieval, written as Spark DataFrame jobs."""
