"""Documents with what breaks operators: nulls, blanks, repeats, ties, a very long text, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, h string"


def awkward() -> list[tuple]:
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    texts = [
        (1, "Hello world, this is a test.\nHello world, this is a test.", "en", "b"),
        (2, "", "en", "b"),
        (3, None, "fr", "a"),
        (4, " \t\n ", None, "a"),
        (5, long_text, "en", "b"),
        (6, "épée Äpfel ñandú 漢字   x", "de", None),
        (7, "same text here", "en", "b"),
        (8, "same text here", "en", "b"),
        (8, "same text here", "en", "b"),
        (None, "no id here", "es", "c"),
        (None, "no id here", "es", "c"),
        (9, "\0 a zero and <|endoftext|> inside", None, None),
        (10, "x" * 5000, "en", "b"),
        (11, "a b c a b c a b c\r\nnext line", "en", "d"),
        (12, "  two  spaces and\ttabs \n\n end ", "en", "b"),
        (13, "tail", "en", ""),
    ]
    return [(d, t, lang, src, len(t or ""), 7, 0.5, "clash") for d, t, lang, src in texts]


def many(n: int, rng) -> list[tuple]:
    """A hot source that holds most rows, and others."""
    out = []
    for i in range(n):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "ε"]) for _ in range(rng.randint(0, 60)))
        out.append((i * 2, words, "en", rng.choice(["hot", "hot", "hot", "hot", "x", "y", "z"]), len(words), 1, 0.0, ""))
    return out
