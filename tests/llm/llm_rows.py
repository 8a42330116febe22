"""Rows that operators must not stumble over."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=1):
    """n words, the same for a seed."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward():
    """Documents with nulls, empty and long texts, copies, repeated rows; (doc_id, text, lang, source, n_chars)."""
    base = prose(80, 3)
    texts = [
        (1, base), (2, base), (3, base + " and a little more than before"), (4, ""), (5, None), (6, "   \n\t  "), (7, "word"), (8, prose(20_000, 5)), (9, "a a a a a a a a a a"),
        (10, "line one\nline one\nline two\r\nline\x0bthree"), (11, prose(60, 9).upper()), (12, "Ünïcödé wörds ñ 漢字 🙂 and more of it"), (13, base), (13, base), (None, prose(70, 11)), (None, None), (14, prose(300, 13)),
    ]
    return [(d, t, "en" if d is None or d % 2 else None, None if d == 7 else f"src{(d or 0) % 3}", len(t or "")) for d, t in texts]
