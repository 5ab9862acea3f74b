"""Chains of stages."""
