"""Disguised personal data: what the transducers match is found whatever else the text holds."""

import random

import pytest
from textloom.llm import pii


def ungated(text):
    base, tape = pii.base_spans(text), pii._addresses(pii._digits(pii._forms(pii.Tape(text))))
    taken, out = [(a, b) for _, a, b in base], []
    for kind, a, b in pii.base_spans(tape.text) if tape.text != text else []:
        s, e = tape.starts[a], tape.ends[b - 1]
        if not any(s < y and x < e for x, y in taken):
            out.append((kind, s, e))
            taken.append((s, e))
    return sorted(base + out, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


@pytest.mark.parametrize("text", ["jane AT example.com", "jane @ example.com", "jane arroba example.es", "jane arobase exemple.fr", "jane@ example.com"])
def test_bare_forms_of_at(text):
    for t in (text, f"– {text}", f"{text} and a [dot]"):
        assert [t[a:b] for _, a, b in pii.all_spans(t)[1]] == [text], t


def test_all_spans_equals_the_ungated_chain():
    rng = random.Random(9)
    ats, dots = [" at ", " AT ", " @ ", "@", " [at] ", "(AT)", " arroba ", " arobase "], [" dot ", "[dot]", " DOT ", ".", " punto "]
    parts = ["jane", "x.y", "example", "com", "pl", " ", "–", "one ", "two ", "555", "+49 ", "plus ", "а", *ats, *dots]
    found = 0
    for _ in range(10_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 6))) + rng.choice([" ", "", ", "])
        t += "jane" + rng.choice(ats) + "example" + rng.choice(dots) + rng.choice(["com", "pl", "es"]) + "".join(rng.choices(parts, k=rng.randint(0, 6)))
        assert pii.all_spans(t)[1] == ungated(t), t
        found += len(pii.all_spans(t)[1]) > len(pii.base_spans(t))
    assert found > 500


@pytest.mark.parametrize(("kind", "text"), [
    ("email", "jane [AT] example [DOT] com"), ("email", "jane(AT)example.com"), ("email", "jane AT example DOT com"), ("email", "jane at example dot pl"), ("email", "jane (at) example.se"),
    ("email", "jane [at] a [dot] b [dot] c [dot] d [dot] e [dot] f [dot] jp"), ("email", "a dot b dot c dot d dot e dot f at example dot app"), ("email", "jane @ example.pl"), ("email", "jane arroba ejemplo punto mx"),
    ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "10 [DOT] 0 [dot] 0.7"), ("phone", "+49 30 one two three four five six"), ("phone", "plus 49 (30) one two three four five six"),
    ("card", "4111 1111 1111 one one one one"), ("phone", "+49 dot 30 dot 12 dot 34 dot 56"),
])
def test_forms_of_disguise(kind, text):
    for t in (text, f"Write to {text}, today", f"{text}\n"):
        if "a dot b" in text and t != text:
            continue  # words before it join the local part
        assert [(k, t[a:b]) for k, a, b in pii.all_spans(t)[1]] == [(kind, text)], t


@pytest.mark.parametrize("text", ["look at example.com", "Look at the point where", "look at this point in time", "at the dot on it", "three point one four", "one, two, three. Four", "@ home", "a (at) b", "in 1 2 3 4 5 6 7 8 9 steps"])
def test_prose_stays(text):
    assert pii.all_spans(text)[1] == []


def test_long_runs_take_no_quadratic_time():
    for part in ["a dot ", "a at ", "one ", "1 dot ", "1.", "(", "[at] ", "@ ", "at dot ", " ", "x at y dot com "]:
        pii.all_spans(part * 20_000)
