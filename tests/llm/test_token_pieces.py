"""How texts reach the tokenizers library in op2_token_files."""

import random

from seqloom.llm import token_files
from seqloom.llm.bytebpe import default_path


def test_words_are_asked_for_once_whatever_stands_after_them():
    lib = token_files.Library(default_path())
    asked, own = [], lib.pre_tokens
    lib.pre_tokens = lambda words: asked.extend(words) or own(words)
    texts = ["one word, a word. Word!\nword", "a word; one\nword? 12 | word"]
    want = [e.ids for e in lib.tok.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in lib.encode_all(texts)] == want
    assert len(asked) == len(set(asked)) and {" word", "word", " Word", " one"} <= set(asked)
    asked.clear()
    assert [i.tolist() for i in lib.encode_all(texts)] == want and not asked


def test_pieces_of_all_kinds_against_the_library():
    r, lib = random.Random(3), token_files.Library(default_path(), most=50)
    texts = ["".join(r.choice("aB é,.|3\n'<中ñ ") for _ in range(r.randrange(14))) for _ in range(3000)] + ["a ", "\n", "|", "<|endoftext|> a", "ab's x's don't"]
    for lo in range(0, len(texts), 300):
        part = texts[lo : lo + 300]
        assert [i.tolist() for i in lib.encode_all(part)] == [e.ids for e in lib.tok.encode_batch(part, add_special_tokens=False)]
