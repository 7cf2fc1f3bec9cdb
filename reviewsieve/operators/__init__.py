"""Relational operators over articles, judgements and reveal logs."""
