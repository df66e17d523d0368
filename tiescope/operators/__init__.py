"""Relational operators: cleaning, pairing, features, profiles, cohorts, graph."""
