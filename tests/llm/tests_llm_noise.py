"""Texts with every kind of repeat, for tests."""

import random


def noisy(seed, n=260, vocabulary=90):
    """Sentences with copies, edits, short ones, nulls and odd characters; few words, so that many are frequent."""
    rng = random.Random(seed)
    out = [None, "", "  ", "коротке речення", "…"]
    while len(out) < n:
        ws = [f"слово{rng.randrange(vocabulary)}" for _ in range(rng.randrange(6, 26))]
        out.append(" ".join(ws))
        for _ in range(rng.randrange(4)):
            edited = ws[:]
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"зміна{rng.randrange(40)}"
            rng.shuffle(edited)
            out.append(" ".join(edited).upper().replace("О", "O") if rng.random() < 0.5 else ", ".join(edited))
    return [(i * 3, t) for i, t in enumerate(out)]
