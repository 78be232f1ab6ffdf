"""Runnable jobs: work in a function that takes a session, with a command line and a small configuration file for each."""
