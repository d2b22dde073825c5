"""Edge cases that every operator takes."""

BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and so on it goes for ever"
PASSAGE = " ".join(f"passage{i} word{i * 7 % 13}" for i in range(40))

#: Nulls, empties, blanks, copies, case, ties, repeated rows, near copies, one long text, shared passages.
EDGE = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " more"), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "One Two"), (9, "É é Ä"), (10, "é é ä"), (None, BASE), (11, BASE), (11, BASE),
    (12, " ".join(f"w{i}" for i in range(9000))), (13, " ".join(f"w{i}" for i in range(9000)) + " end"), (14, "x " + PASSAGE + " y"), (15, PASSAGE + " unlike the rest"), (16, "a" * 1200), (17, BASE.replace("mu", "MU!")),
]
