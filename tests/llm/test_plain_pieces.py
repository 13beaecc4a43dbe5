"""Plain letters and marks are asked of the vocabulary's model alone, and get the ids of whole texts."""

import numpy as np
import public_tokenizers

from cinderlens.llm.simple8b import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["'s a's it's!! <|endoftext|> x<|endoftext|>y a<| |>", "Straße! ÉCOLE école, ﬁ ǆ ß÷ µa ªb don't. ábc, ẍ.", "", "a+b a-b== ---a (b) _a_ 12a 3, a3! ;a; ÿ\x85 \xa0a İI ΑΣ Σ.", "a\x1cb c\x1f, \x00a $$$ ,,,, s' t''"]


def test_ids_are_those_of_whole_texts():
    coder = WordEncoder(PATH, 1)
    for text, ids in zip(ODD, coder.encode([t.encode() for t in ODD]), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_plain_pieces_do_not_go_through_the_normaliser():
    coder = WordEncoder(PATH, 1)
    whole, coder.tokenizer = coder.tokenizer, None
    text = "Lorem ipsum### dolor, grüße. (*) lorem"
    assert np.frombuffer(coder.encode([text.encode()])[0], np.uint32).tolist()[:-1] == whole.encode(text, add_special_tokens=False).ids
