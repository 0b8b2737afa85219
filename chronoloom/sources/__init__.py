"""Readers and writers of commit logs, diffs, source trees, state files and outputs."""
