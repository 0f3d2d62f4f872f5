from tidemark.streaming import shard_scoring

__all__ = ["shard_scoring"]
