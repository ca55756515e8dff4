"""End-to-end plans: rule playlists, cluster playlists and the run modes."""
