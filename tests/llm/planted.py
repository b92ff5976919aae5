"""Texts and rows that the tests of this folder share."""

from __future__ import annotations

import random

WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ironwood", "juniper", "katsura", "larch", "maple", "nutmeg", "oak", "pine"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = "\n".join(prose(i, 60) for i in range(400))
    base = prose(1, 80)
    return [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n\t ", "en", None, None), (4, "word", None, "s", 4), (5, "one two three", "en", "s", 13),
        (6, long, "en", "s", len(long)), (7, base, "en", "s", 1), (8, base, "en", "s", 1), (8, base, "en", "s", 1), (9, base.upper(), "de", "s", 1),
        (None, base, "en", "s", 1), (None, None, None, None, None), (None, "12 34 !!", "fr", "s", 8), (10, "ÉCOLE École x " + base, "fr", "s", 1),
        (11, "line\r\nline\r\nline\r\nline", "en", "s", 1), (11, "other text with the same id", "en", "s", 1), (12, "\u0000x \u0001 y", "en", "s", 1),
    ]
