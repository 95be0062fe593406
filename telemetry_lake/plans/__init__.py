"""Runnable jobs that wire sources, operators and sinks together."""
