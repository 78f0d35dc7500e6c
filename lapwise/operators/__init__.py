"""Operators over iterations, comments, jobs, listings and statement pages."""
