"""Disguised identifiers planted in the documents' own texts: how many are found, and what else is."""

import random

from textloom.llm import pii
from textloom.llm.common import table

from tests.conftest import SMALL

WORDS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
GLYPHS = dict(zip("aeopcx", "аеорсх"))


def email(rng) -> str:
    name, host = (rng.choice(["john", "mary.ann", "k_lee", "p-77", "sales"]) for _ in range(2))
    top = rng.choice(["com", "org", "de", "pl", "io", "jp"])
    at = rng.choice([" [at] ", "(at)", " {AT} ", " at ", " (arroba) ", " @ ", "@"])
    dot = rng.choice([" [dot] ", "(dot)", " dot ", " punto ", " {DOT} "]) if at != "@" else rng.choice([" [dot] ", "(dot)"])
    if at == "@" and rng.random() < 0.5:
        return "".join(GLYPHS.get(c, c) if rng.random() < 0.6 else c for c in f"{name}@{host}.{top}").replace("@", "＠")
    return name.replace(".", dot) + at + host.replace("_", "") + dot + top


def phone(rng) -> str:
    digits = "".join(rng.choices("0123456789", k=rng.randint(9, 12)))
    said = [WORDS[c] if rng.random() < 0.7 else c for c in digits]
    said[1] = WORDS[digits[1]]
    return "plus " + rng.choice([" ", "-", ", "]).join(said)


def address(rng) -> str:
    parts = [str(rng.randint(0, 255)) for _ in range(4)]
    if rng.random() < 0.5:
        return rng.choice([" dot ", " [dot] ", "(dot)"]).join(parts)
    return "".join(chr(0xFF10 + int(c)) if c.isdigit() else "．" for c in ".".join(parts))


def measure(texts: list[str], rng, n: int = 600):
    hit, more = dict.fromkeys(("email", "phone", "ip"), 0), 0
    for k in range(n):
        kind, make = [("email", email), ("phone", phone), ("ip", address)][k % 3]
        words = rng.choice(texts).split()[:200]
        at = rng.randint(0, len(words))
        left, said = " ".join([*words[:at], ""]), make(rng)
        whole = left + said + " " + " ".join(["", *words[at:]])
        base = {(a, b) for _, a, b in pii.base_spans(" ".join(words))}
        spans = [s for s in pii.all_spans(whole)[1] if s[1] < len(left) + len(said) and s[2] > len(left)]
        hit[kind] += any(s[0] == kind and s[1] <= len(left) + 5 and s[2] >= len(left) + len(said) - 3 for s in spans)
        more += max(0, len(pii.all_spans(whole)[1]) - len(base) - 1)
    return {kind: 3 * v / n for kind, v in hit.items()}, more / n


def test_recall_of_planted_disguises(spark):
    texts = [r.text for r in table(spark, SMALL, "documents").orderBy("doc_id").collect() if r.text]
    recall, more = measure(texts, random.Random(12))
    assert min(recall.values()) >= 0.9 and more < 0.02, (recall, more)
