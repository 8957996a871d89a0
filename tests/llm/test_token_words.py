"""Words that the memo lacks."""

import numpy as np
from tokenizers import Tokenizer

from loomwalk.llm import token_files as T


def test_words_with_marks_are_those_of_the_library():
    """A mark behind a word that is known, new in the same text, or no plain word; marks alone; words in several texts."""
    enc, lib = T.WordEncoder(T.default_vocabulary(), most=40), Tokenizer.from_file(T.default_vocabulary())
    texts = ["known plain words", "known. plain, fresh! fresh words? other; other:", "! ,, a.b x.. 7. it's, it's naïve. Grüße!", "ÿ. ß, über; ~ ~. Known: plainly", "known. unknown. fresh!"]
    for text in [*texts, *texts[::-1]]:
        want = [*lib.encode(text, add_special_tokens=False).ids, T.END_ID]
        assert np.frombuffer(enc.encode([text.encode()])[0], enc.dtype).tolist() == want
