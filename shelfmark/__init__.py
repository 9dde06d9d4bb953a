"""Documentation corpora, versioned object catalogs and request logs as Spark jobs."""

from shelfmark.session import configure

__all__ = ["configure"]
