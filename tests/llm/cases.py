"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kd string, marks string"


def documents(spark, texts):
    """Rows of (id, text) with columns whose names clash with those that operators make."""
    rows = [(d, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None if t is None else len(t), 0.5, "x", None) for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def odd_texts():
    return [(901, None), (902, ""), (903, "  \t\n"), (904, "one"), (905, "é   中文 \U0001f600"), (None, "no id at all"), (906, "same text"), (906, "same text"), (907, "tie"), (907, "other tie"), (908, "<|endoftext|> in  a\ttext \n")]


def passages(seed: int = 5, n: int = 60):
    """Texts made of shared passages, repeats, unique words and a very long one."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(4)]
    out = []
    for k in range(n):
        b = rng.choice(base)
        a, size = rng.randint(0, 150), rng.randint(0, 90)
        words = [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 20))] + b[a : a + size] + [f"v{k}"] * rng.randint(0, 4) + rng.choice(base)[: rng.randint(0, 50)]
        out.append((k, " ".join(words)))
    out += [(200, " ".join(rng.choice(vocab) for _ in range(8000))), (201, "a" * 350), (202, "a" * 150), (None, " ".join(base[0])), (5, out[5][1])]
    return out + odd_texts()
