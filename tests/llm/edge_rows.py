"""Rows that every operator has to stand: nulls, blanks, a very long text, repeated rows, odd characters."""

LONG = "lorem ipsum dolor sit amet consectetur " * 20000
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "!!! ???"), (5, "one"), (6, LONG), (7, "the same text of a few words here"),
        (8, "the same text of a few words here"), (8, "the same text of a few words here"), (None, "the same text of a few words here"),
        (None, None), (9, "日本語 e\u0301 \U0001F468\u200d\U0001F469 Σ"), (10, "\x00\u200b")]
