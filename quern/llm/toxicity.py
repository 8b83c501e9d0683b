"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at sentence marks (not at a colon, nor at a mark that a closing quote follows). One automaton
finds words and stems that may start an insult or a threat; each clause with such a hit, however long, is turned into a
row of symbols (hits, pronouns, negations, verbs of saying, quotes, ...), which goes through five composed transducers:

  threat    a harmful act counts only with its target after it, or before it with a speaker or a future
  negation  a hit within three words of a negation is negated; a comma or "but" ends that
  report    a hit in a quotation with a verb of saying before or after it, after such a verb and a colon or "that", after a
            verb of naming ("called him a ..."), or before a comma and a verb of saying ("..., said the man")
  target    a pronoun within four words before a hit or three after it is its target
  weights   of each hit by its label (insult or threat; reported, negated, targeted or plain) and its word

The best path is the clause's reading, its strongest hit the clause's label. A document's score comes from how many of
its clauses have which label and from the strongest word: isolated words count only as the reading of their clause says.
Insult words and stems, the words of threats, their weights, and the weights of labels are learned from a bounded sample of
labelled documents: at most SAMPLE_ROWS of each label, by the order of a hash of the id, each under SAMPLE_CHARS characters,
never held-out rows. A word of a threat is one that stands where a threat has its verb ("I will ... you", "you will ...") in
toxic documents and hardly there in others, so "must pay" or "will beat you at chess" is a threat only where labels say so,
and a threat by a word that no labelled threat holds isn't known. Pronouns, negations, verbs of saying and the like are
fixed lists in four languages. Scoring reads whole texts.

Defined results: a null or empty text has no clause and gets the score of one without hits; repeated rows get repeated
results, and of rows that share an id the sample takes the smallest text; without usable labels no insult is known and the weights are the priors; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drawn, first_of_each, pieces, tidy
from .transducers import Symbol, Transducer, best_path, composed

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
LETTERS = re.compile(r"[^\W\d_]+")
QUOTES = "\"«»„“”‹›"
CLAUSE = re.compile(rf"[.!?;\n]+(?![{QUOTES}.!?;\n])")
MARKS = frozenset(".!?;\n")
FRAME = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[,.!?;\n]")
TOKEN = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|[{QUOTES}:,]")
#: Words of a class, in English, German, French and Spanish.
LISTS = {
    "you": "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos usted ustedes tú ti tus you're you'll",
    "they": "he she him her they them his their sie er il elle ils elles ellos ellas él ella he's she's they're",
    "first": "i we i'll i'm we'll ich wir je j'vais nous yo nosotros",
    "will": "will gonna going shall must should werde werden wirst wird vais va allez vas voy va vais",
    "neg": "not no never isn't aren't wasn't don't doesn't didn't won't can't cannot without nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun aucune nunca jamás sin ni tampoco",
    "report": "said says say saying wrote writes quoted reported reports claimed claims sagte sagt schrieb berichtet dit disait écrit selon rapporte dijo dice escribió según informa",
    "name": "called calls nannte nannten nennt appelé appelle appelait llamó llama llamaron",
    "that": "that dass que qu'il qu'elle",
    "but": "but aber sondern mais pero sino",
}
CLASS_OF = {w: c for c, words in LISTS.items() for w in words.split()} | {q: "quote" for q in QUOTES} | {":": "colon", ",": "but"}
NEGATED, REPORTED, TARGETED = 1, 2, 4
LABELS = tuple(f"{a}{b}" for a in ("insult", "threat") for b in ("", "+target", "+negation", "+report"))
#: What a label adds to a path, by which readings are chosen. An attributed quotation is preferred to one that isn't.
STRENGTH = dict(zip(LABELS, (1.0, 3.0, 0.5, 0.25, 3.0, 4.0, 0.5, 0.25)))
ATTRIBUTED = 100.0
#: Weights before learning: of the constant, of some clause of a label, of the logarithm of how many, of the strongest word.
PRIOR = np.array([-3.0] + [2.0, 5.0, 0.5, 0.5, 5.0, 6.0, 0.5, 0.5] + [0.5] * 8 + [0.3])


def label_of(symbol: Symbol) -> str | None:
    kind, flags, _ = symbol
    if kind not in ("insult", "threat"):
        return None
    return kind + ("+report" if flags & REPORTED else "+negation" if flags & NEGATED else "+target" if flags & TARGETED else "")


def threat_transducer() -> Transducer:
    """harm -> threat with "you" in the four words after it, or before it within two words and a speaker or a future within
    four; "you will ... die". Else it is another word."""
    arcs: dict = {}
    for f in range(5):  # words left in which a speaker or a future counts
        for y in range(4):  # and in which a "you" before counts
            def after(f=f, y=y):
                return (max(f - 1, 0), max(y - 1, 0))

            of = arcs[(f, y)] = {"first": [((4, max(y - 1, 0)), None, 0, 0.0)], "will": [((4, max(y - 1, 0) or int(y > 0)), None, 0, 0.0)], "you": [((max(f - 1, 0), 3), None, 0, 0.0)], "but": [((0, 0), None, 0, 0.0)], "*": [(after(), None, 0, 0.0)]}
            of["harm"] = [(after(), "word", 0, 0.0), (("need", 4), "threat", 0, 0.0)] + ([(after(), "threat", 0, 0.0)] if f and y else [])
            of["end"] = [(after(), "threat" if f and y else "word", 0, 0.0)]
    for k in range(5):
        on = [(("need", k - 1), None, 0, 0.0)] if k else []
        arcs[("need", k)] = {"you": [((0, 3), None, 0, 0.0)], "harm": [(n, "word", 0, w) for n, _, _, w in on], "end": [(n, "word", 0, w) for n, _, _, w in on], "*": on}
    return Transducer((0, 0), arcs, frozenset(("need", k) for k in range(5)))


HITS = ("insult", "threat")


def negation_transducer(words: int = 3) -> Transducer:
    arcs: dict = {}
    for k in range(words + 1):
        flag = NEGATED if k else 0
        arcs[k] = {h: [(k, None, flag, 0.0)] for h in HITS} | {"neg": [(words, None, 0, 0.0)], "but": [(0, None, 0, 0.0)], "*": [(max(k - 1, 0), None, 0, 0.0)]}
    return Transducer(0, arcs)


def report_transducer(words: int = 5) -> Transducer:
    """plain; ("said", k): a verb of saying with k more words for a quote, a colon or "that" to come; ("named", k): a verb of
    naming with k more words for the name; ("opens", 0): after the colon; "quoted" and "told": inside; "other": inside a
    quotation of nobody; "later" and ("closed", k): inside one, and after it, that a verb of saying must follow; ("before", k)
    and ("comma", k): after a hit that a comma and such a verb, of another than the speaker, must follow."""
    on = [("plain", None, 0, 0.0)]
    says = {"report": [(("said", words), None, 0, 0.0)], "name": [(("named", words - 1), None, 0, 0.0)]}
    attributed = {c: [(n, None, 0, ATTRIBUTED) for n, _, _, _ in arcs] for c, arcs in says.items()}
    opened = {"quote": [("quoted", None, 0, 0.0)], "colon": [("opens", None, 0, 0.0)], "that": [("told", None, 0, 0.0)]}
    guess = {h: [*on, (("before", words), None, REPORTED, 0.0)] for h in HITS}
    arcs: dict = {"plain": {**says, **guess, "quote": [("other", None, 0, 0.0), ("later", None, 0, 0.0)], "*": on}}
    for k in range(words + 1):
        less = k - 1
        arcs[("said", k)] = {**says, **guess, **opened, "*": [(("said", less), None, 0, 0.0)] if k else on}
        arcs[("closed", k)] = {**attributed, "*": [(("closed", less), None, 0, 0.0)] if k else []}
        arcs[("before", k)] = {**{h: [(("before", words), None, REPORTED, 0.0)] for h in HITS}, "but": [(("comma", 2), None, 0, 0.0)], "quote": [], "*": [(("before", less), None, 0, 0.0)] if k else []}
    for k in range(words):
        arcs[("named", k)] = {**says, **opened, **{h: [("plain", None, REPORTED, 0.0)] for h in HITS}, "but": on, "*": [(("named", k - 1), None, 0, 0.0)] if k else on}
    for k in range(3):
        arcs[("comma", k)] = {**attributed, **dict.fromkeys((*HITS, "first", "quote", "but"), []), "*": [(("comma", k - 1), None, 0, 0.0)] if k else []}
    arcs["opens"] = {"quote": [("quoted", None, 0, 0.0)], **{h: [("told", None, REPORTED, 0.0)] for h in HITS}, "*": [("told", None, 0, 0.0)]}
    arcs["told"] = {h: [("told", None, REPORTED, 0.0)] for h in HITS} | {"but": on, "*": [("told", None, 0, 0.0)]}
    arcs["quoted"] = {h: [("quoted", None, REPORTED, 0.0)] for h in HITS} | {"quote": on, "*": [("quoted", None, 0, 0.0)]}
    arcs["other"] = {"quote": on, "*": [("other", None, 0, 0.0)]}
    arcs["later"] = {h: [("later", None, REPORTED, 0.0)] for h in HITS} | {"quote": [(("closed", words), None, 0, 0.0)], "*": [("later", None, 0, 0.0)]}
    dead = ["later", *((c, k) for c in ("closed", "before") for k in range(words + 1)), *(("comma", k) for k in range(3))]
    return Transducer("plain", arcs, frozenset(dead))


def target_transducer(before: int = 4, after: int = 3) -> Transducer:
    """k > 0: a pronoun stands at most before - k words back. ("wait", k): one must follow within k words."""
    arcs: dict = {}
    seen = [(before, None, 0, 0.0)]
    for k in range(before + 1):
        hit = [(k, None, TARGETED, 0.0)] if k else [(0, None, 0, 0.0), (("wait", after), None, TARGETED, 0.0)]
        arcs[k] = {h: hit for h in HITS} | {"you": seen, "they": seen, "but": [(0, None, 0, 0.0)], "*": [(max(k - 1, 0), None, 0, 0.0)]}
    for k in range(after + 1):
        off = [(("wait", k - 1), None, 0, 0.0)] if k else []
        arcs[("wait", k)] = {h: [(n, None, TARGETED, w) for n, _, _, w in off] for h in HITS} | {"you": seen, "they": seen, "but": [], "*": off}
    return Transducer(0, arcs, frozenset(("wait", k) for k in range(after + 1)))


class Weights:
    """The last transducer: one state; each hit weighs as its label does, times the weight of its word."""

    start = 0

    def step(self, state, symbol: Symbol):
        label = label_of(symbol)
        return [(0, symbol, STRENGTH[label] * symbol[2] if label else 0.0)]

    def final(self, state) -> bool:
        return True


def grammar():
    return composed(threat_transducer(), negation_transducer(), report_transducer(), target_transducer(), Weights())


def telling(bad: Counter, good: Counter, n_bad: int, n_good: int, purity: float, chance: float) -> set:
    """What stands in toxic documents and hardly in others, in so many that less than `chance` such things are expected among
    all by luck."""
    share, many, least = n_bad / (n_bad + n_good), sorted(bad.values(), reverse=True), 3
    while least <= n_bad and share**least * np.searchsorted([-n for n in many], -least, side="right") > chance:
        least += 1
    return {w for w, n in bad.items() if n >= least and good[w] * n_bad <= purity * n * n_good}


def log_odds(bad: int, good: int, n_bad: int, n_good: int) -> float:
    """Logarithm of how much more frequent a word is in toxic documents, with half a document added to either side."""
    return float(np.log((bad + 0.5) / (n_bad + 1) * (n_good + 1) / (good + 0.5)))


def learned_words(texts: list[str], toxic: list[int], purity: float = 0.02, chance: float = 0.05) -> list[tuple[str, bool, float]]:
    """(stem, whole word only, weight) of the stems that tell toxic documents from others. Of a stem and its continuations
    that stand in nearly as many documents the longest is kept. Its weight is its log_odds."""
    bad, good = Counter(), Counter()
    for text, y in zip(texts, toxic):
        found = set()
        for w in set(LETTERS.findall(text.lower())):
            found.update(w[:k] for k in range(3, min(len(w), 16) + 1))
            found.add(w + "$")
        (bad if y else good).update(found)
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    pure = telling(bad, good, n_bad, n_good, purity, chance)
    longer: dict[str, list[str]] = {}
    for w in pure:
        if not w.endswith("$") and w[:-1] in pure:
            longer.setdefault(w[:-1], []).append(w)
    out: list[tuple[str, bool, float]] = []
    chosen: set[str] = set()
    for w in sorted((x for x in pure if not x.endswith("$")), key=lambda x: (-bad[x], len(x), x)):
        if any(w[:k] in chosen for k in range(3, len(w) + 1)):
            continue
        stem = w
        while nxt := [x for x in longer.get(stem, []) if bad[x] >= 0.95 * bad[w]]:
            stem = max(nxt, key=lambda x: (bad[x], x))
        chosen.update((w, stem))
        out.append((stem, bad[stem + "$"] >= 0.95 * bad[stem], log_odds(bad[stem], good[stem], n_bad, n_good)))
    return out


def threat_frames(text: str, opener: int = 4, target: int = 4, subject: int = 3) -> set[tuple[str, str]]:
    """(word, class) of the words that stand where a threat has its verb: "harm" within four words after a speaker or a future
    with "you" in the four words after, "end" with "you" in the three words before. Commas and clauses end a frame."""
    tokens = FRAME.findall(text.lower())
    out = set()
    for at, t in enumerate(tokens):
        if CLASS_OF.get(t) not in ("first", "will"):
            continue
        for k in range(at + 1, min(at + opener + 1, len(tokens))):
            kind = CLASS_OF.get(tokens[k])
            if kind == "but" or tokens[k] in MARKS:
                break
            if kind is not None:
                continue
            for near, frame in ((tokens[k + 1 : k + target + 1], "harm"), (tokens[max(0, k - subject) : k][::-1], "end")):
                for x in near:
                    if CLASS_OF.get(x) == "you":
                        out.add((tokens[k], frame))
                    if CLASS_OF.get(x) in ("you", "but") or x in MARKS:
                        break
    return out


def threat_words(texts: list[str], toxic: list[int], purity: float = 0.02, chance: float = 0.05) -> list[tuple[str, str, float]]:
    """(word, class, weight) of the words of threats, by the rule of `learned_words` but counted in threat_frames only. A word
    that is both harm and end is harm, which reads either way."""
    bad, good = Counter(), Counter()
    for text, y in zip(texts, toxic):
        (bad if y else good).update(threat_frames(text))
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    out: dict[str, tuple[str, str, float]] = {}
    for w, kind in sorted(telling(bad, good, n_bad, n_good, purity, chance), reverse=True):
        out[w] = (w, kind if w not in out else "harm", log_odds(bad[w, kind], good[w, kind], n_bad, n_good))
    return [out[w] for w in sorted(out)]


class Grammar:
    """The composed transducers behind an automaton that finds where they have something to read."""

    def __init__(self, insults: list[tuple[str, bool, float]], threats: list[tuple[str, str, float]] = ()) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for stem, whole, weight in insults:
            self.automaton.add_word(stem, ("insult", stem, whole, weight))
        for word, kind, weight in threats:
            if word not in self.automaton:
                self.automaton.add_word(word, (kind, word, True, weight))
        self.automaton.make_automaton()
        self.machine = grammar()

    def hits(self, low: str) -> list[tuple[int, str, float]]:
        """(begin, class, weight) of all matches at word starts; of several at one place the longest."""
        if not len(self.automaton):
            return []
        out: dict[int, tuple[int, str, float]] = {}
        for last, (kind, stem, whole, weight) in self.automaton.iter(low):
            a, z = last - len(stem) + 1, last + 1
            if (a and low[a - 1].isalpha()) or (whole and z < len(low) and low[z].isalpha()):
                continue
            out[a] = (a, kind, weight)
        return [out[a] for a in sorted(out)]

    def symbols(self, low: str, begin: int, end: int, hits: dict[int, tuple[str, float]]) -> tuple[list[Symbol], list[float]]:
        """A clause's symbols, and the weights of their words."""
        out, weights = [], []
        for m in TOKEN.finditer(low, begin, end):
            found = [h for at in range(m.start(), m.end()) if (h := hits.get(at))] if hits else []
            kind, weight = max(found, key=lambda x: x[0] == "insult") if found else (CLASS_OF.get(m[0], "word"), 0.0)
            out.append((kind, 0, round(weight, 1)))
            weights.append(weight)
        return out, weights

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """(label, weight of the word) of each clause that has one."""
        low = text.lower()
        hits = self.hits(low)
        if not hits:
            return []
        marks = [m.end() for m in CLAUSE.finditer(low)]
        by: dict[int, dict[int, tuple[str, float]]] = {}
        for a, kind, weight in hits:
            by.setdefault(bisect_right(marks, a), {})[a] = (kind, weight)
        out = []
        for k, mine in by.items():
            symbols, weights = self.symbols(low, marks[k - 1] if k else 0, marks[k] if k < len(marks) else len(low), mine)
            best = best_path(self.machine, symbols)
            labels = [(STRENGTH[x], w, x) for y, w in zip(best[1], weights) if (x := label_of(y))] if best else []
            if labels:
                _, weight, label = max(labels)
                out.append((label, weight))
        return out


def vector(clauses: list[tuple[str, float]]) -> np.ndarray:
    x = np.zeros(len(PRIOR))
    x[0] = 1
    for label, weight in clauses:
        x[9 + LABELS.index(label)] += 1
        x[17] = max(x[17], weight * (STRENGTH[label] >= 1))
    x[1:9] = x[9:17] > 0
    x[9:17] = np.log1p(x[9:17])
    return x


def fitted(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior."""
    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + strength / 2 * np.sum((w - prior) ** 2))

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most `rows` learnable documents of each label; labels' ids are drawn first, so texts aren't shuffled."""
    l = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1) and crc32(cast(id as string)) % 5 != 0")
    ids = first_of_each(drawn(l.groupBy("id").agg(F.max("toxic").alias("toxic")), "toxic", "id", rows).limit(4 * rows).collect(), "toxic", "id", rows)
    few = docs.sparkSession.createDataFrame([(r.id, r.toxic) for r in ids], "id long, toxic int")
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") < SAMPLE_CHARS)
    got = d.join(F.broadcast(few), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.toxic) for r in sorted(got, key=lambda r: r.id)]


def distinct(rows: list[tuple[str, int]], width: int = 3, sketch: int = 4) -> list[tuple[str, int]]:
    """The sample without near copies, whose accidental words would pass for evidence: a document goes if one of its few
    smallest hashes of word runs is one of an earlier document's."""
    import xxhash

    seen: set[int] = set()
    out = []
    for text, y in rows:
        w = LETTERS.findall(text.lower())
        runs = {xxhash.xxh64_intdigest(" ".join(w[k : k + width])) for k in range(max(1, len(w) - width + 1))}
        low = heapq.nsmallest(sketch, runs)
        if seen.isdisjoint(low):
            out.append((text, y))
        seen.update(low)
    return out


def learned(rows: list[tuple[str, int]]) -> tuple[list[tuple[str, bool, float]], np.ndarray, list[tuple[str, str, float]]]:
    """(insults, clause weights, threats): words from two thirds of the sample for clause weights from the rest, where words
    haven't been fitted; then words from all."""
    rows = distinct(rows)
    texts, toxic = [t for t, _ in rows], [y for _, y in rows]
    one, two = [k for k in range(len(rows)) if k % 3], range(0, len(rows), 3)
    if not two:
        return [], PRIOR, []
    some = ([texts[k] for k in one], [toxic[k] for k in one])
    g = Grammar(learned_words(*some), threat_words(*some))
    w = fitted(np.array([vector(g.clauses(texts[k])) for k in two]), np.array([toxic[k] for k in two], float))
    return learned_words(texts, toxic), w, threat_words(texts, toxic)


def scored(docs: DataFrame, words: list[tuple[str, bool, float]], weights: np.ndarray, threats: list[tuple[str, str, float]] = ()) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    none = float(1 / (1 + np.exp(-vector([]) @ weights)))

    def run(batches):
        g = Grammar(words, threats)
        for batch in batches:
            for b in pieces(batch):
                score = []
                for text in b.column("text").to_pylist():
                    c = g.clauses(text) if text else []
                    score.append(none if not c else float(1 / (1 + np.exp(-np.clip(vector(c) @ weights, -30, 30)))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(tidy(run), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, *learned(sample(docs, labels)))
