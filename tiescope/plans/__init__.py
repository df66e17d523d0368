"""Whole jobs: input tables, train and test sets, viewer reports."""
