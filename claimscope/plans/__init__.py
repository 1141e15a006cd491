"""Stages over named tables."""
