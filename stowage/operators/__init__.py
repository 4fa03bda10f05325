"""DataFrame operators over inventory, lifecycle and ledger tables."""
