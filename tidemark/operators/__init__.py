from tidemark.operators import metrics, quality, sampling, splits, trailing, weights

__all__ = ["metrics", "quality", "sampling", "splits", "trailing", "weights"]
