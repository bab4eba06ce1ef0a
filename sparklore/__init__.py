"""Conversation-log analytics as Spark DataFrame jobs."""
