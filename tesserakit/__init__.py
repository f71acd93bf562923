"""Evaluation of labelled volumes and graphs as Spark jobs."""
