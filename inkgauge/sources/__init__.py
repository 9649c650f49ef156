"""Readers of mail, corpora and stores."""
