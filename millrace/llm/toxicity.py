"""Toxicity by a weighted grammar of finite-state transducers, scored clause by clause.

Each transducer rewrites a stream of symbols, one word or mark at a time:

lexicon    words to classes: insult stems learned from labelled rows, threat verbs,
           intent, targets, negation, reporting verbs, contrast, quotation marks, ends;
           words of loose stems, which clean rows hold by chance as well, are insults
           where a text has several different ones
report     marks insults and threats between quotation marks or after a reporting verb
negation   marks those that follow a negation within a few words of its clause
target     marks insults that follow a target within a few words
insult     accepts an insult, aimed if a target precedes it or follows at once
threat     accepts intent, then a threat verb, then a target, each within reach

They are composed, from the lexicon through report, negation and target to insult
and threat, so order and scope decide: "he said scum" is reported, "scum said he"
is not. The product's states are made as texts reach them. A document's score is a
logistic function of the weights of the accepting paths, the first of a kind in
full and more of them ever less; weights come from labelled rows, and patterns that
no labelled row shows keep their prior weights.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkit

#: Labelled rows that are read at most, of either label: the least by a hash of the id.
TRAIN_ROWS = 3000
#: A stem has so many characters, stands in so many toxic families (rows without their copies) at least, and in toxic ones with this share.
STEM_LENGTHS, LEAST_ROWS, LEAST_SHARE = (4, 5, 6, 7), 4, 0.98
#: The log-odds against chance that a stem's families need, and the distinct pairs of words around it (a line that rows share has one).
AGAINST_CHANCE, LEAST_CONTEXTS = 14.0, 4
#: Of families with two different words of a loose stem, this share is toxic at least; of those with enough of any loose stems, that share.
LOOSE_SHARE, AGREED_SHARE = 0.8, 0.95
#: Bands and rows of the sketch that finds near copies in the sample.
BANDS, BAND_ROWS = 16, 3

# fixed word lists of the grammar, by class
THREAT = "kill hurt destroy smash burn murder beat crush punch stab shoot tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGET = "you your yours yourself u ya they them he him she her these those this du dich euch sie dein tu te toi vous ton tus ti usted ustedes vosotros".split()
NEGATION = "not no never none without isn't aren't wasn't don't nicht kein keine nie pas jamais sans ni nunca sin".split()
REPORTED = "said says say called calls claimed claims wrote quoted quote reported alleged dit disait sagte sagt nannte dijo dice llamó".split()
INTENT = "will shall gonna going must should want werde werden wirst vais veux voy quiero".split()
CONTRAST = "but however aber sondern mais pero sino".split()
CLASS_OF = {w: c for c, words in (("T", THREAT), ("U", TARGET), ("N", NEGATION), ("R", REPORTED), ("W", INTENT), ("C", CONTRAST)) for w in words}
CLASS_OF |= dict.fromkeys('"“”«»', "Q") | dict.fromkeys(",;:", ",") | dict.fromkeys(".!?…", ".") | dict.fromkeys("\n\r", "/")

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»,;:.!?…\n\r]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]")
#: How many words a negation, a target, an intent and a threat verb reach ahead; how far behind an insult its target may stand.
NEGATES, AIMS, INTENDS, STRIKES, TURNS = 3, 4, 3, 3, 2
#: More other words than any scope reaches.
FAR = 1 + max(NEGATES, AIMS, INTENDS, STRIKES, TURNS)
PATTERNS = ("insult", "aimed_insult", "threat", "aimed_threat")
MODES = ("", "negated_", "reported_")
FEATURES = [m + p for m in MODES for p in PATTERNS]
#: Log-odds that an accepted path adds before labelled rows are seen: an aimed threat decides by itself.
PRIOR = {"insult": 6.0, "aimed_insult": 7.0, "threat": 1.5, "aimed_threat": 7.0}
PRIOR_MODE = {"": 1.0, "negated_": 0.25, "reported_": 0.5}
PRIOR_BIAS = -4.0

# A transducer maps (state, symbol) to (state, output); None is the start. Symbols are classes, O for other words, with
# the marks r, n and a behind I and T; "," ends a part of a clause, "." a clause, "/" a line. Marks pass unchanged.
MARKS = ",./Q"


def report(state: str | None, symbol: str) -> tuple[str | None, str]:
    """Marks with r what is quoted (until the closing mark or the line's end) or told (until the clause's end or a contrast)."""
    if symbol == "/":
        return None, symbol
    if symbol == "Q":
        return None if state == "quoted" else "quoted", symbol
    if state == "told" and symbol in (".", "C"):
        return None, symbol
    if symbol in "IT" and state:
        return state, symbol + "r"
    return "told" if symbol == "R" and state is None else state, symbol


def negation(state: int | None, symbol: str) -> tuple[int | None, str]:
    """Marks with n the insults and threats that a negation reaches: the state is how many words it still does."""
    if symbol == "N":
        return NEGATES, symbol
    if state is None:
        return None, symbol
    if symbol[0] in ",./C":
        return None, symbol
    if symbol == "Q":
        return state, symbol
    return state - 1 or None, symbol + "n" if symbol[0] in "IT" else symbol


def target(state: int | None, symbol: str) -> tuple[int | None, str]:
    """Marks with a the insults that a target reaches."""
    if symbol == "U":
        return AIMS, symbol
    if state is None or symbol in (",", "Q"):
        return state, symbol
    if symbol in ("/", "."):
        return None, symbol
    return state - 1 or None, symbol + "a" if symbol[0] == "I" else symbol


def _mode(symbol: str) -> str:
    return "reported_" if "r" in symbol else "negated_" if "n" in symbol else ""


def insult(state: tuple[int, str] | None, symbol: str) -> tuple[tuple[int, str] | None, str | None]:
    """Accepts each insult when its clause or its reach ends: the state is the reach left, and what is held."""
    held = state[1] if state else None
    if symbol[0] == "I":
        return (TURNS, _mode(symbol) + ("aimed_insult" if "a" in symbol else "insult")), held
    if state is None:
        return None, None
    if symbol == "U":
        return None, held if "aimed" in held else held.replace("insult", "aimed_insult")
    if symbol in ("/", "."):
        return None, held
    if symbol in (",", "Q"):
        return state, None
    return ((state[0] - 1, held), None) if state[0] > 1 else (None, held)


def threat(state: tuple[int, int, str] | None, symbol: str) -> tuple[tuple[int, int, str] | None, str | None]:
    """Accepts an intended threat, aimed if a target follows it, and a bare threat verb that a target follows at once.

    The state is the reach left of an intent, that of a threat verb, and what is held of it: its mode, ! before if it was intended.
    """
    will, strikes, held = state or (0, 0, "")
    bare = held.startswith("!") and held[1:] + "threat" or None
    if symbol in ("/", "."):
        return None, bare if strikes else None
    if symbol in (",", "Q"):
        return state, None
    if symbol[0] == "T":
        return (0, STRIKES if will else 1, ("!" if will else "") + _mode(symbol)), bare if strikes else None
    if symbol == "U" and strikes:
        return None, held[1:] + "aimed_threat" if bare else held + "threat"
    out = bare if strikes == 1 else None
    will, strikes = INTENDS if symbol == "W" else max(0, will - 1), max(0, strikes - 1)
    return (will, strikes, held if strikes else "") if will or strikes else None, out


class Composed:
    """The composition of transducers: the output of each is the input of the next, and those of the last ones are told."""

    def __init__(self, chain: tuple = (report, negation, target), accepting: tuple = (insult, threat)):
        self.chain, self.accepting = chain, accepting
        self.start = (None,) * (len(chain) + len(accepting))
        self.moves: dict[tuple, tuple] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, tuple]:
        """The next state, and what each accepting transducer tells; made when first asked for."""
        try:
            return self.moves[state, symbol]
        except KeyError:
            after, read = [], symbol
            for own, f in zip(state, self.chain, strict=False):
                own, read = f(own, read)
                after.append(own)
            told = [f(own, read) for own, f in zip(state[len(self.chain) :], self.accepting, strict=True)]
            found = self.moves[state, symbol] = (*after, *(t[0] for t in told)), tuple(t[1] for t in told)
            return found

    def accepted(self, symbols: list[tuple[int, str]]) -> list[tuple[str, int]]:
        """(pattern, place of its insult or threat verb) of all accepted paths. symbols: (place, class) of all but other words."""
        out, state, upto = [], self.start, -1
        held = [0] * len(self.accepting)
        for place, symbol in [*symbols, (symbols[-1][0] + 1, "/")]:
            for _ in range(min(FAR, place - upto - 1)):
                state, told = self.step(state, "O")
                out += [(t, held[k]) for k, t in enumerate(told) if t]
            state, told = self.step(state, symbol)
            out += [(t, held[k]) for k, t in enumerate(told) if t]
            if symbol in "IT":
                held["IT".index(symbol)] = place
            upto = place
        return out


GRAMMAR = Composed()


def _begins(word: str, stems: frozenset[str] | set[str]) -> bool:
    return any(len(word) > n and word[:n] + "*" in stems for n in STEM_LENGTHS)


@dataclass(frozen=True)
class Grammar:
    """The lexicon of insult stems, the patterns' weights, and the loose stems with how many different words of them a text needs."""

    stems: frozenset[str]
    weights: tuple[float, ...]
    bias: float
    loose: frozenset[str] = frozenset()
    agreed: int = 2

    def classes(self, word: str) -> str | None:
        """The lexicon: the class of a word or mark, J for one of a loose stem, none for others."""
        if (found := CLASS_OF.get(word)) is not None:
            return found
        if word in self.stems:
            return "I"
        for n in STEM_LENGTHS:
            if len(word) > n and word[:n] + "*" in self.stems:
                return "I"
        return "J" if _begins(word, self.loose) else None

    def paths(self, text: str, lexicon: Lexicon | None = None) -> list[tuple[str, int, int]]:
        """(pattern, start, end) of each accepted path: the clause around it, in code points of the text."""
        lexicon = Lexicon(self) if lexicon is None else lexicon
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = TOKEN.findall(low)
        classes = list(map(lexicon.__getitem__, words))
        if "J" in classes:
            read = "I" if len({w for w, c in zip(words, classes, strict=True) if c == "J"}) >= self.agreed else None
            classes = [read if c == "J" else c for c in classes]
        if "I" not in classes and "T" not in classes:
            return []
        found = GRAMMAR.accepted([(i, c) for i, c in enumerate(classes) if c])
        if not found:
            return []
        spans = [m.span() for m in TOKEN.finditer(low)]
        out = []
        for pattern, place in found:
            begin = end = place
            while begin and classes[begin - 1] not in (".", "/"):
                begin -= 1
            while end + 1 < len(classes) and classes[end + 1] not in (".", "/"):
                end += 1
            out.append((pattern, spans[begin][0], spans[end][1]))
        return out

    def matches(self, text: str, lexicon: Lexicon | None = None) -> np.ndarray:
        """How often each pattern is accepted in the text."""
        return tally(self.paths(text, lexicon))

    def score(self, counts: np.ndarray) -> float:
        z = self.bias + float(strength(counts) @ np.asarray(self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Lexicon(dict):
    """The classes of words as they are met, forgotten when there are very many."""

    def __init__(self, grammar: Grammar, most: int = 500_000):
        super().__init__()
        self.grammar, self.most = grammar, most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.grammar.classes(word)
        return found


def tally(paths: list[tuple[str, int, int]]) -> np.ndarray:
    counts = np.zeros(len(FEATURES))
    for pattern, *_ in paths:
        counts[FEATURES.index(pattern)] += 1
    return counts


def strength(counts: np.ndarray) -> np.ndarray:
    """What counts of matches weigh: the first in full, more of them ever less."""
    return np.where(counts > 0, 1 + 0.5 * np.log(np.maximum(counts, 1)), 0.0)


def families(texts: list[str]) -> list[int]:
    """For each text the first of its family: equal texts, and those linked by a band of MinHashes of their 5-word shingles."""
    above = list(range(len(texts)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    salts = textkit.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))[:, None]
    equal: dict[str, int] = {}
    bands: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        if (same := equal.setdefault(text, i)) != i:
            above[i] = same
            continue
        hashes = next(textkit.shingle_sets(pa.array([text], pa.string()), 5))
        if not len(hashes):
            continue
        least = textkit.mix(hashes[None, :] ^ salts).min(axis=1).reshape(BANDS, BAND_ROWS)
        for key in enumerate(map(bytes, least)):
            x, y = top(i), top(bands.setdefault(key, i))
            above[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def learn_stems(texts: list[str], toxic: list[int]) -> tuple[frozenset[str], frozenset[str], int]:
    """Words and stems (marked *) that stand in toxic rows nearly always; a stem only if many words begin with it.

    Then the loose stems, which do where two different words of theirs stand in a row,
    and how many different words of loose stems make a row toxic.

    Rows are counted by families, so that copies of a row neither make its words
    evidence nor take it from words that stand elsewhere too.
    """
    def named(words: list[str]) -> dict[str, list[str]]:
        return {w: [w, *(w[:n] + "*" for n in STEM_LENGTHS if len(w) > n)] for w in set(words) if len(w) > 1}

    # the rows of a family and label come one after the other: each name counts once
    rows: dict[tuple[int, int], list[str]] = defaultdict(list)
    for text, family, label in zip(texts, families(texts), toxic, strict=True):
        rows[1 if label else 0, family].append(text)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    twice: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for (label, _), own in rows.items():
        held, several = set(), set()
        for text in set(own):
            found = Counter(s for names in named(WORD.findall(text.lower())).values() for s in names)
            held.update(found)
            several.update(s for s, n in found.items() if n > 1)
        seen[label].update(held)
        twice[label].update(several)
    counts = Counter(label for label, _ in rows)
    chance = -np.log(max(counts[1] / max(1, counts[0] + counts[1]), 1e-9))

    def telling(found: dict[int, Counter], share: float) -> set[str]:
        return {s for s, n in found[1].items() if n >= LEAST_ROWS and n >= share * (n + found[0][s]) and n * chance > AGAINST_CHANCE}

    likely, doubtful = telling(seen, LEAST_SHARE), telling(twice, LOOSE_SHARE)
    del seen, twice
    # of the few that are left, the words that they begin and the pairs that stand around them
    ends: dict[str, set[str]] = defaultdict(set)
    around: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for text in {t for (label, _), own in rows.items() if label for t in own}:
        words = WORD.findall(text.lower())
        names = named(words)
        for w, before, after in zip(words, ["", *words], [*words[1:], ""], strict=False):
            for s in names.get(w, ()):
                if s in likely or s in doubtful:
                    around[s].add((before, after))
                    ends[s].add(w)

    def varied(stems: set[str]) -> set[str]:
        return {s for s in stems if len(around[s]) >= LEAST_CONTEXTS and (not s.endswith("*") or len(ends[s]) >= 4)}

    def uncovered(stems: set[str], by: set[str]) -> set[str]:
        """A word that a stem covers isn't needed, nor a stem that a shorter one covers."""
        return {s for s in stems if not _begins(s.rstrip("*"), by)}

    kept = varied(likely)
    loose = uncovered(varied(doubtful) - kept, kept)
    loose = uncovered(loose, loose)
    # the least number of different words from which families are toxic nearly always
    most = {key: max(sum(_begins(w, loose) for w in set(WORD.findall(text.lower()))) for text in set(own)) for key, own in rows.items()} if loose else {}
    for agreed in range(2, 2 + max(most.values(), default=0)):
        labels = [label for (label, _), n in most.items() if n >= agreed]
        if sum(labels) >= max(LEAST_ROWS, AGREED_SHARE * len(labels)):
            return frozenset(uncovered(kept, kept)), frozenset(loose), agreed
    return frozenset(uncovered(kept, kept)), frozenset(), 2


def train(texts: list[str], toxic: list[int], share: float | None = None, steps: int = 1500) -> Grammar:
    """A grammar from labelled texts: its stems, then the weights of the patterns that they make.

    share: the share of toxic rows in all labelled rows, if the given ones are balanced.
    """
    stems, loose, agreed = learn_stems(texts, toxic)
    prior = np.array([PRIOR[p] * PRIOR_MODE[m] for m in MODES for p in PATTERNS])
    draft = Grammar(stems, tuple(prior), PRIOR_BIAS, loose, agreed)
    lexicon = Lexicon(draft)
    y = np.array([1.0 if x else 0.0 for x in toxic])
    w, bias = prior.copy(), PRIOR_BIAS
    if 0 < y.sum() < len(y):
        x = strength(np.array([draft.matches(t, lexicon) for t in texts]))
        share = y.mean() if share is None else share
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(bias + x @ w, -60, 60)))
            slope = (p - y) * weight
            w -= 4.0 * (x.T @ slope / len(y) + 1e-4 * (w - prior))
            bias -= 4.0 * (slope.mean() + 1e-4 * (bias - PRIOR_BIAS))
    return Grammar(stems, tuple(w.tolist()), float(bias), loose, agreed)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """A grammar from at most `rows` labelled documents of either label that are not held out.

    Where ids repeat in docs, 4 * rows texts are read at most. Rows with a null id,
    text or label don't count. Without labelled rows of both labels the grammar has
    its fixed classes and prior weights alone.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic")).where(~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (True, False)]
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # 2 * rows at most
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * rows).toPandas()
    whole = sum(totals.values())
    return train(sample["text"].tolist(), sample["toxic"].astype(int).tolist(), totals.get(True, 0) / whole if whole else None)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (1 from 0.5 on), matched (how often by pattern), clauses (pattern, start, end in code points).

    A null or empty text matches nothing and has the score of its absence. Null and
    repeated ids keep a row each; other columns, whatever their names, are not read.
    """
    clause = pa.list_(pa.struct([("pattern", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matched", pa.map_(pa.string(), pa.int64())), ("clauses", clause)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(grammar)
        for batch in batches:
            paths = [grammar.paths(x or "", lexicon) for x in batch.column("text").to_pylist()]
            counts = [tally(p) for p in paths]
            scores = pa.array([grammar.score(c) for c in counts], pa.float64())
            matched = pa.array([[(f, int(n)) for f, n in zip(FEATURES, c, strict=True) if n] for c in counts], schema.types[2])
            clauses = pa.array([[{"pattern": f, "start": b, "end": e} for f, b, e in p] for p in paths], clause)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, matched, clauses], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, matched map<string,bigint>, clauses array<struct<pattern: string, start: int, end: int>>")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, matched, clauses; learned from rows that aren't held out. A null id is not held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "matched", "clauses")
