"""lakeloom: ontology-based analytics over heterogeneous sources, compiled to Spark DataFrames."""

__version__ = "0.1.0"
