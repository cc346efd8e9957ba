"""Readers and writers: payloads, the keyed observation table, references, run tables."""
