from tidemark.sources import profile, shards, tables

__all__ = ["profile", "shards", "tables"]
