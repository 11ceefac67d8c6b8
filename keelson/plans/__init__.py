"""Reusable plan shapes: sliced ordered scans, bounded joins, matching, ordered state."""
