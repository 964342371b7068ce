"""Graph retrieval and evaluation over text corpora, written as Spark DataFrame plans."""

__version__ = "0.1.0"
