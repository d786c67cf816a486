"""Whole matching plans."""
