"""Texts of made-up words."""

import random


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join("w" + chr(97 + k // 26) + chr(97 + k % 26) for k in (rng.randrange(words) for _ in range(n)))
