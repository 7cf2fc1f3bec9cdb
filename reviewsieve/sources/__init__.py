"""Readers and writers: judgements, topic tables, article XML, word vectors."""
