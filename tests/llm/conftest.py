import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, key string, size long, sources array<string>, _id long, _w int, _k int, h int"


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with nulls, blanks, copies, near copies, a very long text, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "delta.", "epsilon", "zeta", "ÉTA", "θeta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(30_000)
    base = text(120)
    texts = [None, "", " \t\n", "one", "one two three", base, base, base + " tail", base.upper(), long, long, text(60) + "\n" + "same line here\n" * 3, "x" * 5000, "a\x1cb\x85c <|endoftext|> d", "mail me: a.b@c.example.org or +1 (415) 555-0100, card 4111 1111 1111 1111 at 10.0.0.255", "1.2.3.4.5 256.1.1.1 +12 4111-1111-1111-1112 (415) 555-0199"]
    texts += [text(rng.randint(1, 80)) for _ in range(24)]
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "clash", 7, "clash", 3, ["clash"], 1, 2, 3, 4) for k, t in enumerate(texts)]
    rows += [rows[5], (None, "no id at all, just these words", "en", "s1", 30, "clash", 7, "clash", 3, None, None, None, None, None), (1 << 60, "large id", None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
