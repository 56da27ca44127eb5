"""Operators for preparing large text corpora: extraction, scoring, formatting, language,
media, mixing, decontamination, quality, near duplicates and sharding.

Nothing else in the library imports this subpackage; it stands alone.
"""
