"""Spark jobs for entity x month panels built from noisy, coarser signals."""
