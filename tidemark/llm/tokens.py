"""Token ids of whole Arrow text columns by a public tokenizer that never joins text across ASCII white space.

Text is cut at ASCII white space, each distinct word of a batch is encoded once by the tokenizers library (and kept for
the next batches), and the ids of the texts are gathered from them.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers

from tidemark.llm import words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Words kept between batches; the cache starts anew beyond.
CACHED_WORDS = 600_000

#: New words encoded as one text.
TOGETHER = 500

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """One per worker process and vocabulary file; see ``encoder``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # The vocabulary spells each byte as one character; word ends carry a mark.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix("</w>"))

    def _words(self, found: list[bytes]) -> list[bytes]:
        new = [w for w in found if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known, new = {}, found
            for at in range(0, len(new), TOGETHER):
                part = new[at : at + TOGETHER]
                self.known.update(zip(part, self._together(part) or self._alone(part), strict=True))
        return [self.known[w] for w in found]

    def _alone(self, part: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        return [np.array(c.ids, dtype=np.uint32).tobytes() for c in coded]

    def _together(self, part: list[bytes]) -> list[bytes] | None:
        """Ids of the words encoded as one text, cut where the tokens' bytes make up the words'. None if any word is
        not of plain bytes (a special token's mark, white space of its own) or the sums don't meet."""
        sizes = []
        for word in part:
            if word.isascii():
                size = len(word)
            else:
                text = unicodedata.normalize("NFC", word.decode())
                if any(map(str.isspace, text)):
                    return None
                size = len(text.lower().encode())
            sizes.append(size)
        whole = b"\n".join(part)
        if b"<|" in whole:
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
        upto, ends = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        cut = np.searchsorted(upto, ends)
        if not len(ids) or cut[-1] != len(ids) - 1 or (upto[cut] != ends).any():
            return None
        raw, cut = ids.tobytes(), (4 * (cut + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, each followed by ``end``, and their bounds. Null counts as empty."""
        data, bounds = words.raw(column)
        starts, stops, at = words.spans(data, bounds)
        _, first, which = np.unique(words.hashes(data, starts, stops), return_index=True, return_inverse=True)
        held = data.tobytes()
        coded = self._words([held[s:e] for s, e in zip(starts[first].tolist(), stops[first].tolist(), strict=True)])
        coded.append(np.uint32(end).tobytes())
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        flat, begin = np.frombuffer(b"".join(coded), dtype=np.uint32), np.cumsum(size) - size
        # The end stands after each text's words, as one more word.
        which = np.insert(which, at[1:], len(coded) - 1)
        n = size[which]
        upto = np.cumsum(n)
        ids = flat[np.repeat(begin[which] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.concatenate([[0], upto[at[1:] + np.arange(len(at) - 1)]])


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
