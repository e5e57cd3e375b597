"""Joins, latest states, rollups, detectors and classification, as DataFrame operators."""
