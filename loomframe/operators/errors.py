"""Failures worth a retry."""

TRANSIENT_NAMES = ("TimeoutError", "AbortError")
TRANSIENT_CODES = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "EPIPE")
