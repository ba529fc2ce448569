"""loomsieve: curation, auditing and scoring of conversational corpora as Spark plans."""
