"""Quillon: a Spark-first engine for plate-reading evidence and text corpora."""
