"""Readers, writers and the feeds that shape plain tables into the inputs the operators expect."""
