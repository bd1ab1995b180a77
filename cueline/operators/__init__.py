"""Operators on cue and interval tables."""
