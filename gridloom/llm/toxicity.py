"""Toxic terms found through spelling mistakes, and scored in their context.

A lexicon of words and word stems is mined from labelled texts.  Its trie is
intersected with Levenshtein automata: a state is a set of (trie node, errors)
pairs, determinised lazily, so reading a word costs one table step a letter and
stops at the dead state.  Each hit is looked at in a window of words: quotation
marks around it or a reporting verb before it mark it as quoted.  Logistic
regression on labelled texts that mined no term turns the counts into a score.
"""

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fit_logistic, held_out, logistic, remembered, training_ids

WINDOW = 5
STEMS = (4, 5, 6)
WORD_CACHE = 400_000  # words remembered by a task; beyond, the memory starts anew
# Verbs and nouns that announce a quotation, and quotation marks.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term reported claimed dijo dice llamó palabra dit écrit mot sagte sagt nannte wort".split())
QUOTES = '"“”„«»‘’`'
PRIOR = {1: 0.8, 2: 0.5}  # weight of a form with so many errors before any is seen, as a share of the word's
PART = re.compile(r"[^\W_]+")  # words as mining sees them
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + QUOTES + "…–—¡¿"


def allowed_errors(term):
    """Spelling errors that still count as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyLexicon:
    """Words and stems with weights; ``find(word)`` gives (term, errors) or None.

    A stem matches any word that begins with it, without errors; misspelled
    forms are matched by the words beside it.  Of several matches the one with
    fewest errors counts, then the heaviest.  A word that is a stem too weighs
    as the stem.
    """

    def __init__(self, words, stems, fuzzy=None):
        self.weight = {**words, **stems}
        self.fuzzy = {(t, e): w * k for t, w in words.items() for e, k in PRIOR.items()} | (fuzzy or {})
        self.child, self.ends, self.limit, self.stem = [{}], [None], [0], [None]
        for term in sorted(words):
            self._add(term, allowed_errors(term), False)
        for term in sorted(stems):
            self._add(term, 0, True)
        self.states, self.keys, self.steps, self.final, self.begun = [], {}, [], [], []
        self.start = self._state({(0, 0)})
        self.memory = {}
        self.longest = max((len(t) + allowed_errors(t) for t in self.weight), default=0)

    def _add(self, term, limit, stem):
        node = 0
        self.limit[0] = max(self.limit[0], limit)
        for c in term:
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = len(self.child)
                self.child[node][c] = nxt
                self.child.append({}), self.ends.append(None), self.limit.append(0), self.stem.append(None)
            node = nxt
            self.limit[node] = max(self.limit[node], limit)
        if stem:
            self.stem[node] = term
        else:
            self.ends[node] = (term, limit)

    def _state(self, pairs):
        """The number of the state that holds these pairs, closed under letters missing from the text."""
        best, todo = {}, list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.limit[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.keys:
            self.keys[key] = len(self.states)
            self.states.append(best)
            self.steps.append({})
            ends = [(e, -self.weight[t], t) for n, e in best.items() if self.ends[n] for t, most in [self.ends[n]] if e <= most]
            self.final.append(min(ends) if ends else None)
            stems = [(0, -self.weight[self.stem[n]], self.stem[n]) for n, e in best.items() if e == 0 and self.stem[n]]
            self.begun.append(min(stems) if stems else None)
        return self.keys[key]

    def _step(self, state, c):
        pairs = set()
        for node, e in self.states[state].items():
            pairs.add((node, e + 1))
            pairs |= {(n, e + (k != c)) for k, n in self.child[node].items()}
        self.steps[state][c] = nxt = self._state(pairs)
        return nxt

    def find(self, word):
        """Best match of one lower-case word."""
        state, hit = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
            if hit is None:
                hit = self.begun[state]
        if state >= 0 and self.final[state] is not None:
            hit = min(hit, self.final[state]) if hit else self.final[state]
        return (hit[2], hit[0]) if hit else None

    def parts(self, token):
        """Matches inside a token of several words joined by marks ("liar,idiot").

        Words that match by themselves count; between them, runs of words are read
        with their marks, shortest first, for spellings that mask a letter.
        """
        places = [m.span() for m in PART.finditer(token)]
        own = [self.find(token[a:b]) for a, b in places]
        out, i = [], 0
        while i < len(places):
            hit, after = own[i], i + 1
            for j in range(i + 1, len(places)):
                if hit or own[j] or places[j][1] - places[i][0] > self.longest:
                    break
                hit, after = self.find(token[places[i][0] : places[j][1]]), j + 1
            if hit:
                out.append(hit)
            i = after if hit else i + 1
        return out

    def lookup(self, token):
        """Matches of a raw token without its edge marks, remembered."""
        core = token.strip(EDGES)
        found = self.parts(core) if core and not core.isalnum() else []
        if not found:
            hit = self.find(core)
            found = [hit] if hit else []
        if len(token) <= 40:
            if len(self.memory) >= WORD_CACHE:
                self.memory.clear()
            self.memory[token] = found
        return found

    def hits(self, text):
        """All hits of a text: (word position, term, errors, quoted); a word of several parts may hold several."""
        tokens = (text or "").lower().split()
        if not tokens or not self.weight:
            return [], len(tokens)
        memory, found = self.memory, []
        for i, t in enumerate(tokens):
            own = memory[t] if t in memory else self.lookup(t)
            if own:
                before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
                marks = any(x.lstrip("([{")[:1] in QUOTES for x in before) and any(x.rstrip(".,;:!?)]}")[-1:] in QUOTES for x in after)
                quoted = marks or any(x.strip(EDGES) in REPORTING for x in before[:-1])
                found += [(i, *hit, quoted) for hit in own]
        return found, len(tokens)

    def features(self, text):
        """Summed weights of direct and of quoted hits, the heaviest direct one, direct weight a hundred words."""
        found, n = self.hits(text)
        weights = [(self.fuzzy[t, e] if e else self.weight[t], q) for _, t, e, q in found]
        direct, quoted = sum(w for w, q in weights if not q), sum(w for w, q in weights if q)
        return math.log1p(direct), math.log1p(quoted), max((w for w, q in weights if not q), default=0.0), 100 * direct / (n + 20)


@dataclass
class ToxicityModel:
    """Lexicon and calibration; without calibration every score is ``base``."""

    words: dict
    stems: dict
    fuzzy: dict = field(default_factory=dict)
    weights: tuple = ()
    base: float = 0.0

    def features(self, column):
        words, stems, fuzzy = self.words, self.stems, self.fuzzy

        @F.pandas_udf("array<double>")
        def measure(batches: "pd.Series") -> "pd.Series":
            lexicon = _lexicon(words, stems, fuzzy)
            return pd.Series([list(lexicon.features(t)) for t in batches])

        return measure(F.coalesce(column, F.lit("")))

    def score(self, column):
        """Probability column of toxicity for a text column."""
        words, stems, fuzzy, w, base = self.words, self.stems, self.fuzzy, np.array(self.weights), self.base

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            if not len(w):
                return pd.Series(np.full(len(texts), base))
            lexicon = _lexicon(words, stems, fuzzy)
            return pd.Series(logistic([lexicon.features(t) for t in texts], w))

        return scores(F.coalesce(column, F.lit("")))

    def spans(self, docs):
        """Every hit in every text: doc_id, position, term, errors, quoted."""
        words, stems, fuzzy = self.words, self.stems, self.fuzzy

        def find(batches):
            lexicon = _lexicon(words, stems, fuzzy)
            for b in batches:
                rows = [(d, *h) for d, t in zip(b.doc_id, b.text) for h in lexicon.hits(t)[0]]
                yield pd.DataFrame(rows, columns=["doc_id", "position", "term", "errors", "quoted"])

        return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, position long, term string, errors int, quoted boolean")


def _lexicon(words, stems, fuzzy):
    """A worker's automaton for a lexicon."""
    return remembered("lexicon", (words, stems, fuzzy), lambda: FuzzyLexicon(words, stems, fuzzy))


def _stems(k):
    """Distinct beginnings of k letters of longer words in column w."""
    return F.array_distinct(F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.substring(w, 1, k)))


def mine(rows: DataFrame, terms=400, least_share=0.01, least_odds=1.5):
    """Toxic words and stems of labelled rows (label, text).

    A term is taken if the log-odds of its document frequencies, less two
    standard errors, reach ``least_odds`` and it stands in at least three and in
    ``least_share`` of the toxic texts.  A longer stem inside a stem is left out;
    words stay, as only they are found in misspelled forms.
    Counting is a grouped aggregate; the driver gets at most ``terms`` of each kind.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    words = F.filter(words, lambda w: F.length(w) >= 3)
    rows = rows.select("label", words.alias("w"))
    # most near copies share their four smallest word hashes: a group of them counts once
    rows = rows.withColumn("look", F.slice(F.array_sort(F.transform("w", lambda w: F.xxhash64(w))), 1, 4))
    # the one that counts is chosen by its words, whichever row comes first
    rows = rows.groupBy("label", "look").agg(F.min_by("w", F.xxhash64(F.array_sort("w"))).alias("w"))
    size = rows.agg(F.sum("label").alias("toxic"), F.count("label").alias("all")).first()
    toxic, clean = float(size["toxic"] or 0), float((size["all"] or 0) - (size["toxic"] or 0))
    if not toxic or not clean:
        return {}, {}
    kinds = [F.transform("w", lambda w: F.struct(F.lit(0).alias("stem"), w.alias("term")))]
    kinds += [F.transform(_stems(k), lambda w: F.struct(F.lit(1).alias("stem"), w.alias("term"))) for k in STEMS]
    count = (
        rows.select("label", F.explode(F.concat(*kinds)).alias("t"))
        .groupBy("t.stem", "t.term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where(F.col("a") >= max(3, math.ceil(least_share * toxic)))
        .withColumn("odds", F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1)))
        .withColumn("sure", F.col("odds") - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
        .where(F.col("sure") >= least_odds)
    )
    best = [r for k in (0, 1) for r in count.where(F.col("stem") == k).orderBy(F.desc("sure"), "term").limit(terms).collect()]
    stems, words = {}, {r.term: r.odds for r in best if not r.stem}
    for r in sorted((r for r in best if r.stem), key=lambda r: (len(r.term), r.term)):
        inside = [t for t in words if t.startswith(r.term)]
        # a stem earns its place when more texts hold it than its commonest word accounts for
        if len(inside) != 1 and not any(r.term.startswith(s) for s in stems):
            stems[r.term] = r.odds
    return words, stems


def misspelling_weights(rows: DataFrame, words, stems, prior=2.0):
    """Weight of each word's forms with one and two errors.

    Before any is seen it is a share of the word's own weight; labelled texts
    (doc_id, label, text) that hold such forms pull it to their log-odds, not below zero.
    """
    hits = ToxicityModel(words, stems).spans(rows).where("errors > 0").select("doc_id", "term", "errors").distinct()
    seen = hits.join(rows.select("doc_id", "label"), "doc_id").groupBy("term", "errors").agg(F.sum("label").alias("a"), F.count("*").alias("n")).collect()
    size = rows.agg(F.sum("label"), F.count("label")).first()
    toxic, clean = (size[0] or 0), (size[1] or 0) - (size[0] or 0)
    out = {}
    for r in seen:
        odds = math.log((r.a + 0.5) / (toxic + 1)) - math.log((r.n - r.a + 0.5) / (clean + 1))
        out[r.term, r.errors] = max(0.0, (prior * words[r.term] * PRIOR[r.errors] + r.n * odds) / (prior + r.n))
    return out


def rising_logistic(x, y):
    """Logistic weights without negative ones among the hit counts: such columns leave the fit."""
    x = np.asarray(x, float)
    kept = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, kept], y)
        worst = int(np.argmin(w[:-1])) if kept else -1
        if not kept or w[worst] >= 0:
            full = np.zeros(x.shape[1] + 1)
            full[[*kept, -1]] = w
            return tuple(full)
        kept.pop(worst)


def fit(docs: DataFrame, labels: DataFrame, train_docs=12000) -> ToxicityModel:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fold (crc32(doc_id) mod 4 = 2).

    Two thirds mine the lexicon, one third calibrates.  Without toxic or clean
    rows every score is their share (0 without labels).
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    ids = training_ids(labels, "toxic", 4, 2, train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    mined = rows.where(part != 0)
    words, stems = mine(mined.select("label", "text"))
    model = ToxicityModel(words, stems, misspelling_weights(mined, words, stems))
    cal = rows.where(part == 0).select("doc_id", "label", model.features(F.col("text")).alias("x")).collect()
    cal.sort(key=lambda r: (r.doc_id, r.x))
    y = [r.label for r in cal]
    if len(set(y)) < 2:
        model.base = float(np.mean(y)) if y else 0.0
    else:
        model.weights = rising_logistic([r.x for r in cal], y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold=0.3, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts hold no term and get the score of a text without hits;
    repeated rows get equal scores; an empty table gives an empty result.
    """
    model = fit(docs, labels, **bounds)
    return docs.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), model.score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold=0.3, **bounds) -> DataFrame:
    """The documents with a score under ``threshold``, with all their columns."""
    return docs.where(fit(docs, labels, **bounds).score(F.col("text")) < threshold)
