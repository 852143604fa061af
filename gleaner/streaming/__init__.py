"""Stateful stream control, each as a fold over a key's ordered events, in batch and in Structured Streaming."""
