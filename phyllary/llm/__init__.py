"""Operators for text corpora and entity clean-up; nothing else in the package imports this one."""
