"""Training-data pipeline operators: cleaning, de-duplication, scoring, packing."""
