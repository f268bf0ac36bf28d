"""Treebank and corpus analytics as Spark jobs."""
