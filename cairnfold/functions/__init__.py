"""Expressions, codecs and state machines that operators are made of."""
