"""Column functions: names, frames, labels, prompts, metrics, hashing."""
