"""Structured Streaming versions of the ledger, the commit windows and the token trigger."""
