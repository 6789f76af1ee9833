"""Streaming forms of the counts and of the feedback log; each has a batch form that it must equal."""
