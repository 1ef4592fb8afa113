"""Small documents with copies, near copies, shared passages and odd rows."""

import random


def corpus(seed=1, hot=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(30), text(120)
    docs = [text(rng.randint(1, 150)) for _ in range(40)]
    docs += [base] * 5 + [base.upper()] * 2
    for _ in range(hot):  # near copies of one base, far apart among each other at times
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    docs += [text(rng.randint(0, 40)) + "\n" + passage + "\t" + text(rng.randint(0, 40)) for _ in range(hot // 2)]
    docs += ["", " \t\n", None, "one", "one", "One two three four", "a " * 300, "éè 中文 " * 12, passage, passage[:-2]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def long_text(n=60_000):
    rng = random.Random(3)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
