"""Helpers that operators share: text in normal form, tables staged between the rounds of a loop."""
