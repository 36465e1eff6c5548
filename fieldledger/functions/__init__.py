"""Scalar functions: canonical text, exact numbers, digests."""
