"""Runnable jobs: a function of a session and paths each, a command line and a small config file."""
