"""Matches in progress, as structured streams of frames."""
