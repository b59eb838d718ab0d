"""Training-data operators: duplicates, overlaps, splits, top-N, pair defects, packing, leaks and cuts.

Nothing outside this subpackage imports it.
"""
