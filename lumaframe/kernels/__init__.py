"""Decoding that is sequential within one image: bytes in, arrays out, no Spark."""
