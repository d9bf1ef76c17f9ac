"""A small corpus with every case the operators must stand: nulls, empty, long and repeated texts, copies, passages."""

import random


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice(["an", "er", "té", "ou", "sh", "ß", "in", "la", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]

    def prose(k):
        return " ".join(rng.choice(lexicon).capitalize() if rng.random() < .1 else rng.choice(lexicon) for _ in range(k))

    passage, shared_line = prose(70), prose(9)
    texts = []
    for i in range(n):
        t = prose(rng.choice([3, 8, 25, 60, 120, 200]))
        kind = i % 16
        if kind == 1 and texts:
            t = rng.choice(texts) or ""
        elif kind == 2:
            t = f"{t}\n{passage}\n{prose(10)}"
        elif kind == 3 and texts:
            w = (rng.choice(texts) or "a b c").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 4:
            t = (rng.choice(texts) or "").upper()
        elif kind == 5:
            t = " ".join([rng.choice(lexicon)] * 60 + [rng.choice(lexicon)] * 30)
        elif kind == 6:
            t = f"{shared_line}\n{t}\n{shared_line}\n{shared_line}\n"
        elif kind == 7:
            t = t.replace(" ", "!! ").upper() + "!!"
        elif kind == 8:
            t = rng.choice(["Under the MIT License, mit license", "apache LICENSE, version 2.0", "cc by-nc 4", "under the mit licenses"]) + " " + t
        elif kind == 9:
            t = t.replace(" ", "*** ")
        texts.append(t)
    texts += ["", None, " \t\n", "a", "ab " * 5, "x" * 1000, "x" * 1000, "0123456789" * 60, prose(6000), "<|endoftext|> It's ΣΑΣ", "a\x00b c d", "😀 日本 \r\n\x0b"]
    base = prose(120).split(" ")
    for k in range(25):  # a group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"n{k}"
        texts.append(" ".join(w))
    texts += [prose(40)] * 12
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i] * 3 + 1, t) for i, t in enumerate(texts)]
