"""Any text is taken without failure, and with the defined results."""

import os

import pytest

from siltstone.llm import contamination, spam, tokenize

hypothesis = pytest.importorskip("hypothesis")
st = hypothesis.strategies
texts = st.one_of(st.text(max_size=300), st.text(alphabet="ab <>()[]–-\n.,!?#@/0123Ãâ​́http:www.", max_size=300))
settings = hypothesis.settings(max_examples=300, deadline=None)


@settings
@hypothesis.given(texts)
def test_stuffing(text):
    share, shapes = spam.stuffing(text)
    assert 0 <= share <= 1 and shapes >= 0
    assert text.strip() or share == 0


@settings
@hypothesis.given(texts)
def test_words(text):
    got = contamination.words(text)
    assert all(w and not w.isspace() for w in got)
    assert contamination.words(" ".join(got)) == got or any(not w.isascii() or w.isdigit() for w in got)


@pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary")
def test_encoding_is_a_round_trip():
    with open(tokenize.VOCABULARY, "rb") as f:
        encoder = tokenize.BytePairEncoder(f.read())

    @settings
    @hypothesis.given(texts)
    def check(text):
        assert b"".join(encoder.bytes[i] for i in encoder.encode(text)).decode() == text

    check()
