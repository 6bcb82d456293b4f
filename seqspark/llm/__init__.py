"""Operators for preparing training text: encoding, packing, output files, sharding, removal of
repeats, page extraction, classifiers and searches. Nothing else in the library imports this."""
