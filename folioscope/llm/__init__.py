"""Training-data operators: packing, search, dedup, classification, mixing, scanning, extraction.

Nothing outside this folder imports it; ``queries`` lists what it registers.
"""
