"""Scoring plans: registered post-processors and metrics, and sweeps over candidate settings as one job."""
