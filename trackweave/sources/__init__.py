"""File listings, the feature table and the m3u sink."""
