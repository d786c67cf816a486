"""Readers and writers of fingerprints, results and histories."""
