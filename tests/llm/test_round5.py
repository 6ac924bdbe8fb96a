"""op3_quality: a block's n-grams are worked out once."""

import numpy as np
import pyarrow as pa

from tidemark.llm import quality as Q


class Counted(Q.Model):
    asked = 0

    def look_up(self, keys, values):
        self.asked += len(keys)
        return super().look_up(keys, values)


def parts(texts, stretch):
    return [Q.Stretch(codes, owner, 5) for codes, owner in Q.stretches(pa.array(texts), 5, stretch)]


def model(kind, texts, **settings):
    keys = Q.block_keys(pa.array(texts), 5, 10**6)
    rng = np.random.default_rng(1)
    known = keys[rng.random(len(keys)) < 0.7]
    log_p, back = (rng.normal(size=len(known)).astype(np.float32) for _ in range(2))
    log_p[rng.random(len(known)) < 0.3] = np.nan
    return kind(known, log_p, back, -9.0, **settings)


def test_a_later_stretch_looks_up_nothing_again():
    text = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 3000)))
    m = model(Counted, [text])
    once = m.score(*parts([text], 10**6))
    before = m.asked
    again = [m.score(*parts([text] * n, 10**6)) for n in (1, 3)]
    assert before > 0 and m.asked == before and all(np.array_equal(x, np.tile(once, n)) for n, x in zip((1, 3), again, strict=True))


def test_sums_are_the_same_however_many_are_remembered():
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.choice([97, 98, 99, 0x416, 0x4E2D, 0x1F600], 700))) for _ in range(9)] + ["", "a", None]
    want = np.concatenate([model(Q.Model, texts, most=0).score(p) for p in parts(texts, 500)])
    for most in (1, 300, 10**6):
        m = model(Q.Model, texts, most=most)
        assert np.array_equal(np.concatenate([m.score(p) for p in parts(texts, 500)]), want)


def test_distinct_grams_of_a_stretch():
    for codes, owner in Q.stretches(pa.array(["banana banana", "", "bandana", None]), 5, 10**6):
        s = Q.Stretch(codes, owner, 5)
        at = np.flatnonzero(owner[4:] >= 0)
        keys = Q.gram_keys(codes, 5)
        top = keys[-1][at]
        assert np.array_equal(np.sort(s.suffixes[-1]), np.unique(top)) and np.array_equal(s.suffixes[-1][s.of], top)
        assert all(p == at[np.flatnonzero(top == k)[0]] for p, k in zip(s.place, s.suffixes[-1], strict=True))
        want = np.unique(np.concatenate([keys[k][at + 4 - k] for k in range(5)] + [keys[k][at + 3 - k] for k in range(4)]))
        assert np.array_equal(Q.block_keys(pa.array(["banana banana", "", "bandana", None]), 5, 10**6), want)
