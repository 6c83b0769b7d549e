"""Readers of landed files and writers of the job's own tables."""
