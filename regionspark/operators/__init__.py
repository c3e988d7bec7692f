"""Operators over segments, intervals, regions, trees, sequences and states."""
