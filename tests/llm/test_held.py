"""What workers keep from task to task."""

import weakref

import numpy as np

from seqloom.llm import bytebpe, held, langid, token_files


def test_a_step_drops_what_another_one_holds():
    path = bytebpe.default_path()
    tables = bytebpe.load(path)
    assert bytebpe.load(path) is tables
    seen = weakref.ref(tables)
    del tables
    library = weakref.ref(token_files.load(path))
    assert seen() is None and library() is not None
    field = langid.Field(["a", "b"], {}, 8, np.ones((8, 2)), np.zeros((2, 2)))
    first = langid.word_scores(["x", "yz", "1"], field)[0].tolist()
    assert library() is None and langid.word_scores(["x", "yz", "1"], field)[0].tolist() == first == [1, 2, 0]
    held.release()
    assert not held._HELD


def test_word_scores_start_again_beyond_their_bound():
    field = langid.Field(["a", "b"], {}, 8, np.arange(16.0).reshape(8, 2), np.zeros((2, 2)))
    for words in (["ab", "c"], ["d", "ab"], ["c", "d", "e"]):
        at, scores = langid.word_scores(words, field, most=1)
        assert np.array_equal(scores[at], langid.emissions(words, field))
