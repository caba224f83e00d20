"""Behavioural baselines of distributed-tracing spans, and drift from them, as Spark jobs."""
