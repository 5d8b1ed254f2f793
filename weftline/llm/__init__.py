"""Training-data operators (dedup, decontamination, classification, mixing, ...)."""
