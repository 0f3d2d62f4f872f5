import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import tokens, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c\u0085🙂'9", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes_agree_with_a_regular_expression(texts):
    hashed, bounds = words.hashed(pa.array(texts, pa.string()), lower=True)
    plain = [brute.words(brute.lower(t)) for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(flat)) == len(set(hashed.tolist())) == len({(w, h) for w, h in zip(flat, hashed.tolist(), strict=True)})


def test_hash_does_not_depend_on_place_or_segment(monkeypatch):
    text = pa.array(["aa bb " * 300, None, "bb"])
    one, _ = words.hashed(text)
    monkeypatch.setattr(words, "SEGMENT", 7)
    two, _ = words.hashed(text)
    assert (one == two).all() and len(set(one.tolist())) == 2


def test_shingles_of_short_texts_are_the_whole_text():
    hashed, bounds = words.hashed(pa.array(["a b", "a b c d e", "", "b a"]))
    sets = list(words.shingle_sets(hashed, bounds, 4))
    assert [len(s) for s in sets] == [1, 2, 0, 1] and sets[0][0] != sets[3][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAé \t\n\x0b\x1c\u0085́İΣ🙂's19<|endoftext>日", max_size=30), max_size=5))
def test_cached_encoding_is_the_tokenizers_own(texts):
    coder = tokens.encoder()
    ids, bounds = coder.encode(pa.array([*texts, None, "<|endoftext|> x<|startoftext|>"], pa.string()), 7)
    for i, text in enumerate([*texts, "", "<|endoftext|> x<|startoftext|>"]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 7]
