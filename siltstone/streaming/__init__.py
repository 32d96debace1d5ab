"""Change streams: the queue of pending work, journal replay, and feeds applied as they arrive."""
