"""Words of a batch share the lattice of their common beginnings; ids stay the library's."""

from array import array

from ownerscope.llm import sentencepieces as S


class Counted(dict):
    """A dictionary that counts its look-ups."""
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def test_common_beginnings_are_searched_once():
    model = S.Pieces(S.default_path())
    model.ending = Counted(model.ending)
    model.within("▁interesting")
    first = model.ending.asked
    model.within("▁interestings")
    assert 0 < model.ending.asked - first < first / 2


class Opened(dict):
    """A dictionary that counts its items' readings."""
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_symbol_outside_the_vocabulary_is_spelled_once():
    model = S.Pieces(S.default_path())
    model.byte = Opened(model.byte)
    for n in (1, 2, 9):
        word = "▁" + "\U0001f9ff" * n
        assert list(array("I", model.within(word))) == list(model.model.encode("\U0001f9ff" * n))
    assert "\U0001f9ff" not in model.id and model.byte.asked == 4


def test_repeated_marks_and_spaces_give_the_ids_of_the_library():
    model = S.Pieces(S.default_path())
    texts = ["▁▁é", "é▁ b▁", "  é  b  ", "▁", "▁▁", " é", "é\n\n b", "é ▁▁ ,.", "\u3000é"]
    assert [list(array("I", i)) for i in model.encode(texts)] == [model.model.encode(t) for t in texts]


def test_any_order_of_words_gives_the_ids_of_the_library():
    model = S.Pieces(S.default_path())
    words = ["the", "then", "中文", "the", "th", "x" * 63, "x" * 64 + "é", "😀the", "a\nb", "", "ñandú", "ñan", "éé中é", "Inc.,", "x" * 70]
    texts = words + [" ".join(words), " ".join(reversed(words))] + words[::-1]
    assert [list(array("I", i)) for i in model.encode(texts)] == [model.model.encode(t) for t in texts]
    for t in ("▁the", "▁then", "▁", "", "▁th中", "▁th中文"):
        assert list(array("I", model.within(t))) == list(model.stream(t))
