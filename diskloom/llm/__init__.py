"""Training-data operators: linkage, canonical values, duplicates, tokens, leakage, abuse."""
