"""Find e-mail addresses and web links in text corpora with Spark."""
