"""Small corpora with the awkward cases, and brute-force versions."""

import random
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, ids string, key bigint"


def words(text, lower=True):
    return WORDS.findall((text or "").translate(LOWER) if lower else text or "")


def prose(rng, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=60):
    """Prose with exact and near copies, shared passages, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(n)]
    texts[5] = texts[3]
    texts[6] = texts[3].upper()
    for k in (8, 9, 10):
        w = texts[7].split()
        for _ in range(k - 7):
            w[rng.randrange(len(w))] = "changed"
        texts[k] = " ".join(w)
    passage = prose(rng, 60)
    for k in (20, 21, 22):
        texts[k] = f"{texts[k]}\n{passage} {prose(rng, 20)}"
    line = prose(rng, 12)
    for k in (30, 31, 32):
        texts[k] = f"{prose(rng, 10)}\n{line}\n\n{prose(rng, 15)}"
    texts[33] = f"{line} more\n{line.replace(' ', '  ', 1)}\nshort one\nshort two"
    texts[34] = f"short one\n{line.rsplit(' ', 1)[0]} other\n {prose(rng, 9)}"
    texts += [None, "", "   \n\t ", "one", "One", "two words", "word " * 3000, "x" * 20000, "a\u0000b é中 \U0001f600"]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "clash", "clash", i) for i, t in enumerate(texts)]
