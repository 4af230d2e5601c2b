import math
import random

import pytest

from chunklens.operators import chunkers as C


def test_part_losses():
    assert C.part_losses([2, 2], [4.0, 1.0, 3.0]) == [4.0, 2.0]
    assert math.isnan(C.part_losses([1, 1], [5.0])[0])
    assert C.part_losses([], []) == []


def test_loss_chunks():
    assert C.loss_chunks(["a sixsix", "b", "longer word"]) == [["a sixsix", "b"], ["longer word"]]
    assert C.loss_chunks([]) == []


def test_decisions():
    assert C.decided_chunks([]) == []
    assert C.decided_chunks(["a", "b c d e f g h i j", "k"]) == [("a", False), ("b c d e f g h i j", False), ("k", False)]


class Tight:
    """A decision that can't hold more than so many words of one unit, and none of some words."""

    def __init__(self, most, never=()):
        self.most, self.never, self.held, self.last = most, never, 0, None

    def __call__(self, a, b):
        self.held = len(b.split()) + (self.held if a == self.last else len(a.split()))
        self.last = b
        if self.held > self.most or set((a + " " + b).split()) & set(self.never):
            raise MemoryError
        return len(a) != len(b)


def test_windows_of_tokens_after_a_memory_error():
    parts = ["aa bb.", "cc dd.", "e f.", "gg hh.", "ii jj."]
    assert C.decided_chunks(parts, Tight(99)) == [("aa bb. cc dd.", False), ("e f.", False), ("gg hh. ii jj.", False)]
    # cut by tokens, through the sentence "cc dd."
    assert C.decided_chunks(parts, Tight(4), 3) == [("aa bb.", False), ("cc", False), ("dd.", False), ("e f.", False), ("gg hh.", False), ("ii", False), ("jj.", False)]


def test_what_is_lost_is_told():
    parts = ["aa bb.", "cc dd.", "ee ff.", "gg hh."]
    got = C.decided_chunks(parts, Tight(4, ["ff."]), 4)
    assert got == [("aa bb. cc dd.", False), ("ee ff. gg hh.", True)]
    got = C.decided_chunks(parts, Tight(4, ["dd."]), 4)
    assert [lost for _, lost in got] == [True, True] and " ".join(t for t, _ in got) == " ".join(parts)
    with pytest.raises(ValueError):
        C.decided_chunks(parts, lambda a, b: int("x"))


class Counting:
    """Loss of a token: how many tokens it was read after, so that context shows."""

    def __init__(self):
        self.calls = []

    def tokens(self, part):
        return part.split()

    def losses(self, context, batch):
        self.calls.append((len(context), len(batch)))
        return [float(len(context) + i) for i in range(len(batch))]


def test_losses_join_over_batch_edges():
    parts = ["a b c", "d", "e f g h", "i j"]
    for batch in (1, 2, 3, 4, 99):
        assert C.batched_losses(parts, Counting(), batch, 999) == ([3, 1, 4, 2], [float(i) for i in range(1, 10)])
    m = Counting()
    C.batched_losses(parts, m, 4, 6)
    assert m.calls == [(0, 4), (2, 4), (4, 2)]  # context and batch are at most six tokens
    assert C.batched_losses([], Counting()) == ([], [])


@pytest.mark.parametrize("batch, most", [(1, 1), (7, 20), (64, 70), (4096, 9000)])
def test_long_path_equals_short_path_without_context(batch, most):
    r = random.Random(batch)
    for _ in range(20):
        parts = [" ".join("x" * r.randint(1, 9) for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 40))]
        assert C.long_loss_chunks(parts, None, 0.5, batch, most) == C.loss_chunks(parts)


def test_merged_chunks():
    w = lambda n: " ".join(["w"] * n)
    assert C.merged_chunks([w(150), w(60), w(40)], 200) == [" " + w(150), w(60) + " " + w(40)]
    assert C.merged_chunks([w(250), w(1)], 200) == ["", w(250), w(1)]
    assert C.merged_chunks(["abc", "de", "f"], 4, words=False) == ["abc", "def"] and C.merged_chunks([], 9) == []


def test_clauses():
    assert C.clauses("One, two; \tthree.  ?") == ["One", "two", "three"]
