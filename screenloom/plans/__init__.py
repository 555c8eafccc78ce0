"""Registered queries: a Spark plan and, where SQL can say it, the same question as SQL."""
