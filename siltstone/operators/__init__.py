"""Relational operators that Spark lacks or spells otherwise."""
