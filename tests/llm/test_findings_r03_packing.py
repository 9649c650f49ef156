"""op5 over its CPU budget: stems were forgotten all at once, and found again each."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkgauge.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_stems_are_kept_for_two_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    monkeypatch.setattr(packing, "STEMS", 20, raising=False)
    with open(WORD, encoding="utf-8") as f:
        model = f.read()
    encoder, tk, asked = packing.WordEncoder(model), Tokenizer.from_str(model), []
    plain = encoder._stem
    encoder._stem = lambda stem: asked.append(stem) or plain(stem)
    texts = [f"Wörter{chr(97 + k)}, été{chr(97 + k)}!" for k in range(12)] * 2
    for t in texts:
        assert encoder.encode(t) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(asked) < 1.5 * len({*asked})  # most stems were found once, though more than a generation holds came between; before, each was found twice
