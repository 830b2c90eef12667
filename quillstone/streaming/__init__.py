"""State machines over events, in batch and as a stream, and incremental folder jobs."""
