"""Changes feeds and replication."""
