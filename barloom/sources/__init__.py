"""Normalisers for landed raw tables and the table/CSV sinks."""
