"""Readers of files, catalogs and recorded datasets."""
