"""Training-data pipeline operators: tokenising, filtering, de-duplication, search, packing and archives."""
