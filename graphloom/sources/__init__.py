"""Readers and writers of the file formats that the jobs exchange."""
