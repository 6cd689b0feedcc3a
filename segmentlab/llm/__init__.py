"""Operators for preparing training text: mixing, deduplication, decontamination, extraction and scans.

Nothing else in the library imports this subpackage. Every operator first selects the
columns that it needs, so extra columns of any name never meet its own.
"""
