"""Split, leakage and evaluation audits as Spark plans."""

__version__ = "0.1.0"
