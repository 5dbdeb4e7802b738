"""Survey-table cleaning, enrichment and compliance checks as Spark plans."""

__version__ = "0.1.0"
