"""Generalised LL parsing of source files: engine, tokens and dialect grammars."""
