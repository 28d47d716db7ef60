"""Connectors: a registry of readers, landing tables for raw answers, licensed slots, JSON readers and writers."""
