import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseflow.llm.encode import encoder
from caseflow.llm.words import Words, slices

ODD = st.text(alphabet=st.sampled_from("abAB's TΣςİßé\n\t\x0b\x1c\x85\xa0 　中ﬁ😀½²Ⅷ12_.,!|<>endoftext"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        w = Words(data, offsets)
        rows = [[] for _ in range(w.rows)]
        for s, e, r in zip(w.starts, w.ends, w.row):
            rows[r].append(bytes(data[s:e]).decode())
        got += rows
        hashes = dict(zip(w.hashes().tolist(), (x for r in rows for x in r)))
        assert len(hashes) == len({x for r in rows for x in r})
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_is_the_librarys(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(ODD, st.text(max_size=30)))
    def check(text):
        assert np.frombuffer(encoder(path)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    check()
    for text in ("", "<|endoftext|> a", "hello <|endoftext|> you", "a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000, "it's  we'll\n\n so"):
        assert np.frombuffer(encoder(path)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
