"""Readers and writers for recordings, logs, clip indexes, frames and result documents."""
