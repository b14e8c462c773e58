"""Logical plans that several operators share: the record hierarchy and the joined page view."""
