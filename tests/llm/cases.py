"""Small texts with copies, shared passages and odd rows, the same on every run."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]


def texts(seed=1, n=60):
    """``(doc_id, text)``: plain texts, exact and near copies, shared passages, repeats, empty, null, one very long."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    out = []
    for i in range(n):
        w = words(rng, rng.choice([0, 1, 4, 12, 60, 150, 300]), 5000)
        kind = i % 8
        if kind == 1:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        elif kind == 2 and out and out[-1][1]:
            w = WORD.findall(out[-1][1])
        elif kind == 3 and len(w) > 50:
            w[5] = "edited"
            out.append((1000 + i, " ".join(w[:5] + ["other"] + w[6:])))
        elif kind == 4:
            w = (w[:7] or ["again"]) * 40
        out.append((i, rng.choice([" ", " ", "\n", "  "]).join(w)))
    out += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "é" * 3000), (2004, " ".join(words(rng, 9000))), (None, "no id here")]
    return out
