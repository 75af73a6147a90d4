"""Word-wise encoding gives what the library gives on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattspan.llm import token_cache as tc

ODD = st.text(st.sampled_from(list("ab Zé'sS.,!_1²Ⅷ \t\n\r\x1c\x85  ΣσΑ한é̀İ🙂µ×<|>endoftxt")), max_size=60)
CASES = [("byte_bpe_50k.json", public_tokenizers.PATTERN), ("word_bpe_49k.json", None)]


@pytest.mark.parametrize("name, pattern", CASES)
@settings(max_examples=1500, deadline=None)
@given(text=ODD | st.text(max_size=40))
def test_same_ids(name, pattern, text):
    path = public_tokenizers.path(name)
    enc = tc.encoder(path, pattern)
    assert enc.memo.make in (enc._piece, enc._word)  # the fast ways are the ones under test
    ids = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids


def test_memo_keeps_hot_words_and_stays_bounded():
    made = []
    m = tc.Memo(lambda w: made.append(w) or w.encode(), 5 * tc.ENTRY_BYTES)
    for i in range(100):
        assert m["hot"] == b"hot" and m[f"w{i}"] == f"w{i}".encode()
        m.age()
        assert len(m) + len(m.old) <= 14 and m.size <= 5 * tc.ENTRY_BYTES + 400
    assert made.count("hot") == 1
    long = "x" * 500
    assert m[long] == long.encode() and long not in m
    assert Tokenizer is not None and public_tokenizers.PATTERN == tc.BYTE_LEVEL
