"""The library gets units many in a text, in texts that are not long; ids are those of each unit for itself."""

import random

import public_tokenizers

from quern.llm import tokens

ODD = ["a\n\nb", "\n", " ", "x\r\ny", " \n", "a\nb\nc", "'s\n's", " é\n中", "a \nb", "a\n b", "<|endoftext|>", "q\x1c\nr", "a\tb", "..\n..", " x\n'll", "", "z\n"]


class Spy:
    def __init__(self, inner):
        self.inner, self.texts = inner, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **how)


def test_units_with_line_ends_go_together():
    r = random.Random(3)
    some = ["".join(r.choice("abcdeé,.'7\n") for _ in range(r.randint(1, 9))) for _ in range(400)]
    units = [" " + x if r.random() < 0.7 else x for x in some] + ODD + [f" w{k}.\nnext{k}" for k in range(2000)]
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.t = Spy(e.t)
    ids, ends = e([u.encode() for u in units])
    begins = [0, *ends.tolist()]
    for k, u in enumerate(units):
        assert ids[begins[k] : begins[k + 1]].tolist() == e.t.inner.encode(u, add_special_tokens=False).ids, u
    together = sum(" w" in x for x in e.t.texts)
    assert together <= 2000 // tokens.JOINED + 2
    assert max(x.count("next") for x in e.t.texts) <= tokens.JOINED < 1000
