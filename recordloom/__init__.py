"""Record decoding, reconciliation and custody checks as Spark plans."""
