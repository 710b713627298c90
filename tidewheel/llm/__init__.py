"""Training-data operators: quality, decontamination, dedup, filters, scans, language, archives, packing.

Nothing outside this subpackage imports it.
"""
