from tidemark.functions import scalars, text, vectors

__all__ = ["scalars", "text", "vectors"]
