"""Plain versions of what the operators compute."""

import random
import re

WORDS = "ab cd efg hij klm nop qrs tuv wxyz über straße niño él the of and".split()

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def shingle_set(text, n=5):
    w = spaced(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
