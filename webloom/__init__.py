"""Captured web sites as tables: link graphs, bounded crawls, local layouts and exports on Spark."""

from .options import CMS, CMS_EXPORT, CMS_WITH_BACKUP, GENERIC, CrawlOptions

__all__ = ["CMS", "CMS_EXPORT", "CMS_WITH_BACKUP", "GENERIC", "CrawlOptions"]
