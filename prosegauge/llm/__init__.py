"""Training-data operators: scoring, de-duplication, search, packing, mixing and archives."""
