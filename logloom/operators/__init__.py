"""DataFrame-to-DataFrame operators over the session ledger."""
