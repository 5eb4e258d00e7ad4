"""DataFrame operators for count tables, sequence collections and designed trials."""

__version__ = "0.1.0"
