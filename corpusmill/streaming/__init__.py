"""Streams of ledgers, events and documents, each started over whatever files are there and ended when they are read."""
