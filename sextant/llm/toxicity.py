"""Toxicity: a lexicon trie walked by Levenshtein automata, with context windows and a logistic score.

Lexicon: terms (word beginnings) whose documents are nearly all labelled toxic, found greedily in a bounded sample of
labelled documents.  The terms stand in a trie.  A token is matched by running the Levenshtein automaton of the token
(a row of the edit table per state) down the trie, so that all terms within one edit are found in one walk; terms that
are usually whole words must end with the token, others may go on.  Each hit is looked at in a window of words: quote
marks, reporting verbs or a negation around it mark a quotation, words of address or a repeated hit mark abuse.  Counts of
exact, misspelled, quoted and addressed hits per document feed one logistic unit.

Every whole text is scored, a very long one as one row of words; empty and null texts have no hit and get the score of
none.  Equal texts have equal scores; repeated rows and null ids are scored each.  Labels are used in the fit alone;
without labels of both classes there are no terms and every score is that of no hit.  An empty table gives an empty
result.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fold, labelled_sample, map_texts

SAMPLE, SAMPLE_CHARS, MIN_DOCS, MEMO, WINDOW = 3000, 12_000, 8, 400_000, 6
#: Fixed values.
STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…"
QUOTES = set("\"'«»“”„‘’")
REPORTING = {"said", "says", "wrote", "quote", "quoted", "quotes", "called", "not", "dijo", "dit", "sagte"}
ADDRESS = {"you", "your", "you're", "u", "tu", "toi", "du", "dich", "usted", "ustedes"}


class Trie:
    """Nodes are dicts; a term ends where None leads to (term, whole)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.root: dict = {}
        for term, whole in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = (term, whole)

    def search(self, token: str, edits: int = 1) -> tuple[str, int] | None:
        """The nearest term within edits of the token (or of a beginning of it): (term, distance)."""
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(token) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, nxt in node.items():
                if c is None:
                    term, whole = nxt
                    d = row[-1] if whole else min(row)
                    if d <= edits and (d == 0 or len(term) >= 5) and (best is None or (d, term) < best):
                        best = (d, term)
                    continue
                new = [row[0] + 1]
                for i, t in enumerate(token):
                    new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (t != c)))
                if min(new) <= edits:
                    stack.append((nxt, new))
        return (best[1], best[0]) if best else None


def sieve(terms: list[tuple[str, bool]]) -> re.Pattern:
    """A token within one edit of a term has one half of the term unchanged: at its start, or in the rest."""
    starts, ends, inner = set(), set(), set()
    for t, whole in terms:
        h = len(t) // 2
        starts.add(t[:h])
        (ends if whole else inner).add((t[h:], h))
    alts = [re.escape(s) for s in sorted(starts)]
    alts += [f".{{{h - 1},{h + 1}}}{re.escape(s)}" for s, h in sorted(inner)] + [f".{{{h - 1},{h + 1}}}{re.escape(s)}$" for s, h in sorted(ends)]
    return re.compile("(?:" + "|".join(alts) + ")" if alts else "(?!)", re.S)


class Matcher:
    def __init__(self, terms: list[tuple[str, bool]]):
        self.trie, self.sieve, self.longest = Trie(terms), sieve(terms), max([len(t) for t, _ in terms], default=0)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def learn(self, tokens: set[str]) -> None:
        """Every token is put in clean or hits."""
        if len(self.clean) > MEMO:
            self.clean.clear()
        if len(self.hits) > MEMO:
            self.hits.clear()
        for raw in tokens - self.clean:
            if raw not in self.hits:
                token = raw.strip(STRIP)
                # A start of the token decides for terms that may go on; a whole term is no longer than longest + 1.
                found = self.trie.search(token[: self.longest + 2]) if self.sieve.match(token) else None
                if found:
                    self.hits[raw] = found
                else:
                    self.clean.add(raw)

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        kinds = set(tokens)
        self.learn(kinds)
        if kinds <= self.clean:
            return [0.0] * 6
        exact = fuzzy = quoted = addressed = 0
        seen: set[str] = set()
        for i, t in enumerate(tokens):
            hit = self.hits.get(t)
            if hit is None:
                continue
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            exact += hit[1] == 0
            fuzzy += hit[1] > 0
            seen.add(hit[0])
            quoted += any(w[0] in QUOTES or w[-1] in QUOTES or w.strip(STRIP) in REPORTING for w in near)
            addressed += any(w.strip(STRIP) in ADDRESS for w in near) or any(w in self.hits for w in near if w != t)
        per = 100.0 / max(20, len(tokens))
        return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(exact > 1), float(np.log1p(per * exact)), (quoted - addressed) / (exact + fuzzy), float(np.log1p(len(seen)))]


def learn_terms(sample: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Word beginnings of 4 to 10 characters that hardly occur outside toxic documents, by greedy cover.  All of them: only the
    sample bounds their number."""
    where: dict[str, set[int]] = defaultdict(set)
    clean: Counter = Counter()
    whole: Counter = Counter()
    starts: Counter = Counter()
    toxic = []
    for text, y in sample:
        words = {t for t in (w.strip(STRIP) for w in text.lower().split()) if len(t) >= 4}
        begins = {w[:k] for w in words for k in range(4, min(10, len(w)) + 1)}
        if y:
            k = len(toxic)
            toxic.append(k)
            for b in begins:
                where[b].add(k)
            starts.update(w[:k] for w in words for k in range(4, min(10, len(w)) + 1))
            whole.update(words)
        else:
            clean.update(begins)
    n_clean = max(1, len(sample) - len(toxic))
    odds = lambda b: (len(where[b]) / max(1, len(toxic))) / ((clean[b] + 0.5) / n_clean)
    pool = sorted((b for b in where if len(where[b]) >= MIN_DOCS and odds(b) >= 30), key=lambda b: (-len(where[b]), -len(b), b))
    terms: list[str] = []
    left = Counter({k: 3 for k in toxic})  # a document may be covered three times: terms that go together are all found
    for b in pool:
        gain = sum(left[k] > 0 for k in where[b])
        if gain >= MIN_DOCS and not any(b.startswith(t) or t.startswith(b) for t in terms):
            terms.append(b)
            left.subtract(where[b])
    return [(t, whole[t] >= 0.8 * starts[t]) for t in terms]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def train(sample: list[tuple[str, int]]) -> dict:
    terms = learn_terms(sample)
    m = Matcher(terms)
    x, y = np.array([m.features(t) for t, _ in sample] or np.zeros((0, 6))), np.array([float(v) for _, v in sample])
    return {"terms": terms, "w": logistic(x, y)}


_matchers: dict = {}


def predict(model: dict, texts: list[str]) -> np.ndarray:
    key = (tuple(model["terms"]), tuple(model["w"]))
    if key not in _matchers:  # a worker keeps its matcher, and so what it knows of tokens
        _matchers.clear()
        _matchers[key] = Matcher(model["terms"])
    x = np.array([_matchers[key].features(t) for t in texts] or np.zeros((0, 6)))
    return 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted; the labels of fold 2 of 4 are never learned from."""
    model = train(labelled_sample(docs, labels.where(fold(F.col("doc_id"), 4) != 2), "toxic", per_class, max_chars))
    rows = map_texts(docs.withColumn("held_out", fold(F.col("doc_id"), 4) == 2), ["doc_id", "held_out"], lambda texts: [predict(model, texts)], "score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
