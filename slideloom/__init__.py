"""Corpus jobs on Spark: catalogues, slide search, grouping, caches, chunks, chat logs and change streams."""
