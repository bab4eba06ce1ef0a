"""DataFrame operators: discovery, transcripts, patterns, matching, merging, search."""
