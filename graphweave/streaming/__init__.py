"""Subscriptions: queries whose root is a stream."""
