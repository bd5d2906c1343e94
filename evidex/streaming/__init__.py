"""Structured Streaming forms of the receipts, leases, heartbeats and quotas."""
