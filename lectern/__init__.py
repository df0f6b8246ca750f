"""Conversation-log analytics, document preparation and retrieval as Spark plans."""
