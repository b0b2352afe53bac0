"""Operators that prepare a text corpus for training, each a function of DataFrames.

Tasks that run Python import this package by name, so a cluster needs it on the
executors' path (``--py-files`` or an installed wheel).
"""
