"""Screen recordings and input logs to per-frame actions, clips, examples and scores, on Spark."""
