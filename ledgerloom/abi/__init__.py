"""Contract interfaces: parsing, hashing and log decoding."""
