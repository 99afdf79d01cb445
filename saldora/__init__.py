"""saldora: reconciliation and review of structured business documents on Spark."""
