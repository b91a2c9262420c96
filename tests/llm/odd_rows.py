"""Rows that every operator must take: nulls, empty and very long texts, repeats."""

LONG = "word " * 40_000 + "x" * 300_000

ODD = [(None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "A b c."), (4, "A b c."), (5, "é😀 \x1c ß"), (6, LONG), (6, LONG), (7, "#" * 5000)]
