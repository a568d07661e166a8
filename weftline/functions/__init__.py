"""Column functions: normalisation, hashing, rounding, similarity, phonetics."""
