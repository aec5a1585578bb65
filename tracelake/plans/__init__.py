"""Planners: from task tables and file catalogs to validated plans."""
