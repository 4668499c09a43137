"""Binding of the operators to the star-schema test tables, with SQL oracles."""
