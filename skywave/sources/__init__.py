"""Readers and decoders of line, frame and sample streams."""
