"""Toxicity: a lexicon learned from labels, met by a Levenshtein automaton intersected with its trie.

Whole terms and word stems whose presence marks the label significantly (Bonferroni over the features that could pass, after Tarone) make the lexicon.
Terms of FUZZY_FROM letters or more also match at edit distance 1: the product of trie and automaton is determinised lazily, and
most words leave it after two or three letters. Quotation marks, however far, and words of speech in a window before each hit
separate quotation and report from abuse; a hit whose window addresses someone counts in full. A ridge logistic
regression over the hits gives the score. Labels are learned from about `bound` labelled rows; every text is scored whole.
Misspelled stems, terms shorter than FUZZY_FROM and terms of a strength under 0.9 are not sought.

Empty and null texts have no hits; without usable labels the score is the base rate, or 0 without any label. Every row is scored
by itself, equal texts alike; where labels repeat an id, 1 wins; words of equal evidence go by length, then letters; an empty
table gives no rows; other columns, whatever their names, are not read; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, held_out, labelled_sample, map_batches, materialize, texts

#: About so many labelled rows are learned from.
BOUND = 20_000
FUZZY_FROM, STEM_FROM, STEM_TO = 5, 3, 8
#: The label's rate among documents that hold a term, at least.
LEAST = 0.4
#: What share of the documents with a stem may show the same letter after it.
BRANCH = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Weight of a quoted or reported hit; words on each side that are looked at, in its own sentence and within REACH characters.
QUOTED, WINDOW, REACH = 0.25, 5, 200
_STOP = re.compile(r"[.!?\n]")
_MARK = re.compile("[\"“”«»„‘’'\n]")
_OPENS = frozenset("\"“«„‘'")
_CLOSES = {'"': '"', "”": "“„", "“": "„", "»": "«", "’": "‘", "'": "'"}
SPEECH = frozenset("said says wrote writes called calling quote quoted quoting word term insult dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your youre du dein deine sie ihr tu toi vous ton ta eres tú usted".split())


class Product:
    """Levenshtein automaton (distance 1) of a word times the trie of terms, as a DFA made on demand."""

    def __init__(self, terms):
        self.kids, self.ends = [{}], [False]
        for t in terms:
            at = 0
            for c in t:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(False)
                at = self.kids[at][c]
            self.ends[at] = True
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[bool] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        for node, e in list(best.items()):  # a skipped letter of the term
            if e == 0:
                for kid in self.kids[node].values():
                    best.setdefault(kid, 1)
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(any(self.ends[n] for n, _ in key))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, kid in self.kids[node].items():
                cost = e + (letter != c)
                if cost <= 1 and cost < best.get(kid, 2):
                    best[kid] = cost
            if e == 0 and best.get(node, 2) > 1:  # an extra letter in the word
                best[node] = 1
        self.moves[state][c] = to = self._state(best)
        return to

    def match(self, word: str) -> bool:
        s, moves, dead = self.start, self.moves, self.dead
        for c in word:
            s = moves[s].get(c)
            if s is None:
                return self._slow(word)
            if s == dead:
                return False
        return self.accepts[s]

    def _slow(self, word: str) -> bool:
        s = self.start
        for c in word:
            to = self.moves[s].get(c)
            s = self._move(s, c) if to is None else to
            if s == self.dead:
                return False
        return self.accepts[s]


class Lexicon:
    def __init__(self, terms, stems, not_terms=()):
        self.terms, self.stems, self.not_terms = dict(terms), dict(stems), frozenset(not_terms)
        self.cuts = sorted({len(s) for s in stems})
        self.dfa = Product(t for t in sorted(self.terms) if len(t) >= FUZZY_FROM and self.terms[t] > 0.9)  # only sure terms match loosely

    def __reduce__(self):
        return Lexicon, (self.terms, self.stems, self.not_terms)

    def look_up(self, word: str) -> tuple[int, float]:
        """Kind (0 no hit, 1 term, 2 stem, 3 misspelled term) and strength."""
        if word in self.terms:
            return 1, self.terms[word]
        for n in self.cuts:
            if len(word) > n and word[:n] in self.stems:
                return 2, self.stems[word[:n]]
        return (3, 1.0) if self.dfa.match(word) and word not in self.not_terms else (0, 0.0)

    def hits(self, text: str):
        """(words in all, [(start, end, word, kind, weight)]): weight: the term's strength, times QUOTED for a quoted or reported hit that addresses nobody."""
        low = text.lower()
        words = WORD.findall(low)
        bad = {w: k for w in set(words) if (k := self.look_up(w))[0]}
        found = []
        if bad:
            inside, k = quotations(low), 0
            for m in WORD.finditer(low):
                if hit := bad.get(m[0]):
                    while k < len(inside) and inside[k][1] <= m.start():
                        k += 1
                    quoted = k < len(inside) and inside[k][0] < m.start()
                    found.append((m.start(), m.end(), m[0], hit[0], hit[1] * self._weight(low, m.start(), m.end(), quoted)))
        return len(words), found

    @staticmethod
    def _weight(low: str, a: int, b: int, quoted: bool) -> float:
        left, right = _STOP.split(low[max(0, a - REACH) : a])[-1], _STOP.split(low[b : b + REACH])[0]
        near = WORD.findall(left)[-WINDOW:]
        reported = quoted or any(w in SPEECH for w in near)
        return QUOTED if reported and not any(w in ADDRESS for w in near + WORD.findall(right)[:WINDOW]) else 1.0


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans in quotation marks that open and close in one line, in order and merged where they overlap; of any length."""
    opened: dict[str, int] = {}
    spans = []
    for m in _MARK.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            opened.clear()
            continue
        before, after = text[at - 1 : at].isalnum(), text[at + 1 : at + 2].isalnum()
        if c in "'’" and (before and after or c == "'" and not before and not after and "'" not in opened):
            continue  # an apostrophe
        pair = next((x for x in _CLOSES.get(c, ()) if x in opened), None)
        if pair and not (c == "'" and after):
            spans.append((opened.pop(pair), at))
        elif c in _OPENS and (c != "'" or after):
            opened.setdefault(c, at)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def features(lexicon: Lexicon, text: str) -> list[float]:
    n, found = lexicon.hits(text)
    by = [sum(h[4] for h in found if h[3] == k) for k in (1, 2, 3)]
    return [1.0, *map(math.log1p, by), min(1.0, sum(by) / max(n, 1) * 20), math.log1p(len({h[2] for h in found}))]


def _one_of_each(sample: DataFrame) -> DataFrame:
    """One text of those near copies that share the least hash of a word pair, so that a much copied text does not make its words terms."""

    def run(ids, ys, values):
        keys = []
        for t in values:
            w = WORD.findall(t.lower())
            keys.append(min((xxhash.xxh64_intdigest(a + " " + b, 1) for a, b in zip(w, w[1:])), default=xxhash.xxh64_intdigest(t, 2)) >> 1)
        return ids, ys, values, keys

    rows = map_batches(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, text string, key long")
    return materialize(rows.groupBy("key", "label").agg(F.min_by("text", "doc_id").alias("text")))


def _counts(sample: DataFrame) -> DataFrame:
    """feature, n, pos: in how many sampled documents, and toxic ones, a word (w) or word start (p) stands."""

    def run(values, labels):
        n, pos = Counter(), Counter()
        for t, y in zip(values, labels):
            words = set(WORD.findall(t.lower()))
            got = {"w" + w for w in words} | {"p" + w[:k] for w in words for k in range(STEM_FROM, min(STEM_TO + 1, len(w) - 1) + 1)}
            n.update(got)
            if y:
                pos.update(got)
        return [*n], [*n.values()], [pos[f] for f in n]

    parts = map_batches(sample.select("text", "label"), run, "feature string, n long, pos long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def testable(sizes: dict[int, int], rate: float, level: float = 0.01) -> int:
    """How many features count in the Bonferroni correction (Tarone): those that could pass it if all their documents had the label. sizes: features by the number of their documents."""
    total = sum(sizes.values())
    for n in sorted(sizes):
        if rate**n * max(1, total) < level:
            return max(1, total)
        total -= sizes[n]
    return max(1, total)


def _choose(rows, n_docs: int, n_pos: int, n_features: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with their strength: how far the label's rate where they stand exceeds its rate at large, 0 to 1."""
    rate = max(n_pos, 1) / max(n_docs, 1)
    good = []
    for f, n, pos in rows:
        tail = pos * math.log(rate) + math.lgamma(n + 1) - math.lgamma(pos + 1) - math.lgamma(n - pos + 1)
        if pos >= LEAST * n and tail + math.log(n_features) < math.log(0.01):
            good.append(((pos - n * rate) / math.sqrt(n), f, n, (pos / n - rate) / (1 - rate)))
    words, stems = {}, {}
    longer: dict[str, Counter] = {}
    for f, n, _ in rows:
        longer.setdefault(f[1:-1], Counter())[f[-1]] += n
    for _, f, n, strength in sorted(good, key=lambda x: (-x[0], x[1][0] == "p", len(x[1]), x[1])):
        t = f[1:]
        if any(t.startswith(x) for x in stems):
            continue
        if f[0] == "w":
            words[t] = strength
        elif len(t) <= STEM_TO and not any(x.startswith(t) for x in (*stems, *words)) and max(longer.get(t, Counter()).values(), default=0) <= BRANCH * n:  # a family of words that part here, not one word
            stems[t] = strength
    return {w: v for w, v in words.items() if not any(w.startswith(x) for x in stems)}, stems


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = BOUND, label: str = "toxic"):
    """(lexicon, weights), from about `bound` labelled rows outside the held-out fold."""
    sample = materialize(labelled_sample(docs, labels, label, modulus, held, bound))
    n_docs, n_pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_pos < n_docs:
        drop_tables(sample)
        return Lexicon({}, {}), np.array([30.0 if n_docs and n_pos else -30.0, 0, 0, 0, 0, 0])
    single = _one_of_each(sample)
    n_docs, n_pos = single.agg(F.count("*"), F.sum("label")).first()
    counts = materialize(_counts(single))
    rows = counts.where(F.col("pos") >= F.greatest(F.lit(3), LEAST * F.col("n"))).collect()  # of a sample of bounded size
    sizes = {r.n: r["count"] for r in counts.groupBy(F.least("n", F.lit(60)).alias("n")).count().collect()}
    terms, stems = _choose(rows, n_docs, n_pos, testable(sizes, n_pos / n_docs))
    first = Lexicon(terms, stems)

    def near(words, ns, poss):
        keep = [k for k, w in enumerate(words) if first.look_up(w)[0] == 3]
        return [words[k] for k in keep], [ns[k] for k in keep], [poss[k] for k in keep]

    spelled = map_batches(counts.where("feature like 'w%'").select(F.substring("feature", 2, 1 << 30), "n", "pos"), near, "word string, n long, pos long").collect()
    lexicon = Lexicon(terms, stems, [w for w, n, pos in spelled if n - pos >= 2 and pos < 0.5 * n])
    got = map_batches(sample.select("text", "label"), lambda ts, ys: ([features(lexicon, t) for t in ts], ys), "x array<double>, y int").collect()
    x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got], float)
    for t in (sample, single, counts):
        drop_tables(t)
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3, 0.5, 0.5, 0.5, 0.5, 0.5])
    prior = np.array([0, 2.0, 2.0, 1.5, 0, 0])
    w[1:] = prior[1:]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * (w - prior))
    return lexicon, w


def score(docs: DataFrame, model, modulus: int = 3, held: int = 1) -> DataFrame:
    lexicon, w = model

    def run(ids, values):
        out = []
        for t in values:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(lexicon, t), w))))))
            out.append((p, int(p >= 0.7)))
        return ids, *zip(*out)

    return map_batches(texts(docs), run, "doc_id long, score double, predicted int").select("doc_id", held_out(modulus, held).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score(docs, train(docs, labels))
