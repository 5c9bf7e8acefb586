"""loadweave: load-profile analytics and synthesis as lazy Spark plans."""

__version__ = "0.1.0"
