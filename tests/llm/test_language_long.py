import random

from sparkweave.llm import langid


def test_bytes_beyond_the_window_count_alike():
    rnd = random.Random(1)
    letters = lambda n: bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz", k=n))
    a, b, noise = letters(200_000), letters(200_000), letters(1_300_000)
    x, y = langid.Model({"a": a, "b": b}).sizes(noise + b)
    assert x - y > 50_000
