"""Rows that are awkward in every way."""

SHARED = "The quick brown fox jumps over the lazy dog and runs far away from the angry farmer who shouts at it all day long. "


def text(seed: int, words: int) -> str:
    """Invented prose that depends on the seed alone."""
    parts = ["an", "er", "ti", "on", "the", "re", "in", "st", "ble", "ou", "ly", "wh", "é", "ñ"]
    state, out = seed * 7919 + 13, []
    for _ in range(words):
        word = ""
        for _ in range(2 + state % 3):
            state = (state * 1103515245 + 12345) % (1 << 31)
            word += parts[(state >> 16) % len(parts)]
        out.append(word)
    return " ".join(out) + "."


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, short and long texts, copies, near copies, repeated rows and equal ids."""
    long = text(1, 3000)
    near = text(2, 200).split(" ")
    rows = [
        (1, None, None),
        (2, "", "x"),
        (3, "", "y"),
        (4, "a", None),
        (5, long, "x"),
        (6, long, "x"),
        (7, " ".join(near), "x"),
        (8, " ".join([*near[:100], "changed", *near[101:]]), "x"),
        (9, text(3, 60) + " " + SHARED * 3, "y"),
        (10, SHARED * 2 + text(4, 80), "y"),
        (10, text(5, 50), "z"),
        (11, text(6, 40), "z"),
        (11, text(6, 40), "z"),
        (None, text(7, 40), "z"),
        (None, long, None),
        (12, "  \n\n \t", "z"),
        (13, "For " * 400, "z"),
        (14, "日本語のテキスト😀 ▁ \x00 <|endoftext|> é", "z"),
    ]
    return rows + [(100 + i, text(100 + i, 30 + 7 * i), "fill") for i in range(40)]
