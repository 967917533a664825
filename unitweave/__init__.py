"""Spark jobs over patterns of syntactic units: extraction, counting, selection, vectors, forests, evaluation."""
