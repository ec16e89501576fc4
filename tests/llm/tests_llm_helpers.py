"""Brute-force versions that several tests share."""

from test_linededup import brute as brute_lines  # noqa: F401
from test_minhash import brute as brute_near  # noqa: F401
