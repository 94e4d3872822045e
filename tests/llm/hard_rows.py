"""Rows with what operators must bear: nulls, empty, blank and long texts, repeated rows and identifiers."""

LONG = "A long line of many words here. " * 3000
HARD = [
    (1, "Same Text\nand a repeated line\nx"),
    (2, "same text\nAND a repeated line \nx"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (None, "no identifier at all\nand a repeated line"),
    (6, LONG),
    (7, LONG.lower()),
    (8, "Ünïcode é and a repeated line"),
    (9, "same text\nand a repeated line\nx"),
    (9, "same text\nand a repeated line\nx"),
    (10, "one two three four"),
    (11, "One two three FOUR"),
    (12, "🙂日本語 ½ 1,000 <s>hi</s>"),
]
