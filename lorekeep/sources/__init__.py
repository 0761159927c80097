"""Stores, imports, exports and queues."""
