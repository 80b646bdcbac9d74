"""Batch operators over logs, subscriptions and decoded events."""
