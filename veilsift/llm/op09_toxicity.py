"""Toxicity (9): a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reporting verb, clause end or
other.  Small transducers, one each, follow them: insult and threat emit, target, negation
and reported speech remember for how long they hold.  Their composition, one table of
states, emits for every insult or threat a *pattern*: plain or aimed at somebody, negated
or not, reported or not.  Targets also stand after the word, so a target transducer reads
each clause backwards as well, and either of the two aims the pattern.  A clause ends at a
full stop or its like in any script, at a colon or semicolon and at the end of a line; it
scores the weights it emits by pattern, and a document is judged by these sums, not by
isolated words.

Insults are word beginnings of 3 to 8 letters and whole words whose documents are labelled
toxic far more often than others, with their log odds as weights, besides a short list of
common ones.  What each pattern means is a logistic regression.  Both are learned from a
bounded sample of labelled rows (``fit_rows``, by hash of the id), never from rows whose
crc32(doc_id as text) mod 5 is 0; ``lang``, ``source`` and the id are no inputs.

Null and empty texts get the score of a text without any pattern.  Labels that are null are
ignored, several labels of an id count as their maximum; without two classes of labels the
built-in list and weights are used.  Repeated rows are scored each for itself, extra
columns pass through, an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, split_words, texts_of, written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

#: Word lists of the grammar: the functional words of the languages it reads.
WORDS = {
    INSULT: "idiot moron stupid dumb fool loser pathetic worthless disgusting scum trash clown jerk imbecile",
    THREAT: "kill hurt destroy punish beat crush burn shoot stab strangle",
    TARGET: "you your yours yourself u ur he she they him her them du dich dir ihr sie tu toi vous te ti usted ustedes vosotros",
    NEGATION: "not no never neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine nie ne jamais nunca tampoco",
    REPORT: "said says say wrote writes quoted quotes reported reports claimed claims called according sagte schrieb dit disait écrit dijo dice escribió",
}
#: A line end, as a word of its own.
LINE = "\x1e"
#: What ends a clause at the end of a word, closing quotes and brackets aside.
CLOSING = r"[.!?;:…。．！？；：।॥؟؛۔።]['\"’”»)\]]*$"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡。．！？；：।॥؟؛۔።"
_LENGTHS = range(3, 9)


class Machine:
    """A transducer: ``step(state, symbol)`` gives the next state and what it reports of the symbol."""

    def __init__(self, step):
        self.step = step


def holding(symbol: int, words: int | None) -> Machine:
    """Remembers ``symbol`` for the next ``words`` words, or up to the end of the clause."""

    def step(state, s):
        held = state > 0
        if s == END:
            return 0, held
        if s == symbol:
            return words or 1, held
        return (state if words is None else max(state - 1, 0)), held

    return Machine(step)


def emitting(symbol: int) -> Machine:
    return Machine(lambda state, s: (0, s == symbol))


def compose(machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """The joint machine over all reachable states: tables of next states and of emitted patterns.

    ``machines`` are insult, threat, target, negation, report; a pattern is -1 (nothing) or
    threat + 2 * aimed + 4 * negated + 8 * reported.
    """
    numbers, rows, emits = {(0,) * len(machines): 0}, [], []
    waiting = [(0,) * len(machines)]
    while waiting:
        state = waiting.pop(0)
        row, out = [], []
        for symbol in range(7):
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            after, told = tuple(s for s, _ in steps), [t for _, t in steps]
            if after not in numbers:
                numbers[after] = len(numbers)
                waiting.append(after)
            row.append(numbers[after])
            out.append(told[1] + 2 * told[2] + 4 * told[3] + 8 * told[4] if told[0] or told[1] else -1)
        rows.append(row)
        emits.append(out)
    return np.array(rows), np.array(emits)


#: Which machine looks for a target after a word, on the clause read backwards.
BACKWARDS = holding(TARGET, 4)
AIMED = 2
NEXT, EMIT = compose([emitting(INSULT), emitting(THREAT), holding(TARGET, 4), holding(NEGATION, 3), holding(REPORT, None)])
PATTERNS = 16
FEATURES = PATTERNS + 4


def _bare(vocabulary: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(vocabulary), characters=_MARKS)


def _aimed_after(words: list[int], kinds: list[int]) -> set[int]:
    """The insults and threats of a clause that a target follows; ``words`` are the places of its symbols."""
    out, state, place = set(), 0, None
    for word, kind in zip(reversed(words), reversed(kinds)):
        for _ in range(min(place - word - 1, state) if place is not None else 0):
            state, _held = BACKWARDS.step(state, OTHER)
        # a closing word ends the clause after itself, so it is no end on the way back
        state, held = BACKWARDS.step(state, OTHER if kind == END else kind)
        if held and kind in (INSULT, THREAT):
            out.add(word)
        place = word
    return out


class Grammar:
    """The word lists with learned weights; ``stems`` maps a beginning (``lowe*``) or a word to a weight."""

    def __init__(self, stems: dict[str, float]):
        self.whole = {w: (kind, 1.0) for kind, words in WORDS.items() for w in words.split()}
        for w in WORDS[INSULT].split():
            self.whole[w] = (INSULT, max(4.0, stems.get(w, 4.0)))
        for w, weight in stems.items():
            if not w.endswith("*") and self.whole.get(w, (INSULT,))[0] == INSULT:
                self.whole[w] = (INSULT, weight)
        self.stems = {w[:-1]: weight for w, weight in stems.items() if w.endswith("*")}
        self.heads = {w[:3] for w in self.stems}

    def symbol(self, word: str) -> tuple[int, float]:
        known = self.whole.get(word)
        if known:
            return known
        if word[:3] in self.heads:
            for k in range(min(len(word), 8), 2, -1):
                weight = self.stems.get(word[:k])
                if weight is not None:
                    return INSULT, weight
        return OTHER, 0.0

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: log sums of emitted weights by pattern, the largest clause, density, matches, 1."""
        starts, codes, vocabulary = split_words(pc.replace_substring(texts, "\n", f" {LINE} "))
        bare = _bare(vocabulary).to_pylist()
        read = [(END, 0.0) if w == LINE else self.symbol(w) for w in bare]
        kinds = np.array([k for k, _ in read], np.int8)
        weights = np.array([w for _, w in read])
        closes = pc.match_substring_regex(vocabulary, CLOSING).to_numpy(zero_copy_only=False).astype(bool) | (kinds == END)
        out = np.zeros((len(texts), FEATURES))
        out[:, -1] = 1
        symbols = kinds[codes]
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        told = np.flatnonzero(symbols != OTHER)
        ends = np.flatnonzero(closes[codes])
        breaks = np.concatenate(([0], np.cumsum(symbols == END)))  # line ends are no words of a text
        owner = np.searchsorted(starts, hits, side="right") - 1
        for row, own in itertools.groupby(zip(owner.tolist(), hits.tolist()), key=lambda p: p[0]):
            lo, hi = int(starts[row]), int(starts[row + 1])
            done, sums, largest, count = lo, np.zeros(PATTERNS), 0.0, 0
            for _, at in own:
                if at < done:
                    continue  # its clause has been read
                k = int(np.searchsorted(ends, at))
                first = max(lo, int(ends[k - 1]) + 1 if k else 0)
                done = min(hi, int(ends[k]) + 1 if k < len(ends) else hi)
                state, clause, place = 0, 0.0, first
                words = told[np.searchsorted(told, first) : np.searchsorted(told, done)].tolist()
                aimed = _aimed_after(words, kinds[codes[words]].tolist())
                for word in words:
                    while place < word and NEXT[state, OTHER] != state:
                        state = NEXT[state, OTHER]
                        place += 1  # once other words change nothing, the rest of them is passed over
                    code = codes[word]
                    emitted = EMIT[state, kinds[code]]
                    if emitted >= 0:
                        sums[emitted | AIMED if word in aimed else emitted] += weights[code]
                        clause += weights[code]
                        count += 1
                    state = NEXT[state, kinds[code]]
                    place = word + 1
                largest = max(largest, clause)
            out[row, :PATTERNS] = np.log1p(sums)
            out[row, PATTERNS] = largest
            out[row, PATTERNS + 1] = 100 * sums.sum() / (hi - lo - int(breaks[hi] - breaks[lo]) + 50)
            out[row, PATTERNS + 2] = math.log1p(count)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; columns are scaled, the last one is the constant."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray):
        self.grammar, self.weights = grammar, weights

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.grammar.features(texts) @ self.weights, -30, 30)))


def _counts(sample: DataFrame, wanted=None) -> DataFrame:
    """In how many texts each word beginning and word occurs (only ``wanted`` ones, if given)."""

    def run(batches):
        for batch in sliced(batches, 1 << 21):
            starts, codes, vocabulary = split_words(texts_of(batch))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            bare = _bare(vocabulary)
            for k in (*_LENGTHS, None):
                form = bare if k is None else pc.utf8_slice_codeunits(bare, 0, k)
                fits = pc.greater_equal(pc.utf8_length(bare), k or 3).to_numpy(zero_copy_only=False)
                coded = form.dictionary_encode()
                of_word = coded.indices.to_numpy(zero_copy_only=False)
                use = fits[codes]
                pairs = np.unique(row[use] * max(len(coded.dictionary), 1) + of_word[codes[use]])
                counts = np.bincount(pairs % max(len(coded.dictionary), 1), minlength=len(coded.dictionary))
                names = [w + "*" * (k is not None) for w in coded.dictionary.to_pylist()]
                rows = [(w, int(c)) for w, c in zip(names, counts) if c and (wanted is None or w in wanted.value)]
                yield pa.record_batch(
                    [pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["stem", "n"]
                )

    return sample.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, most_stems: int = 20_000) -> Model:
    """Learn stems and pattern weights from at most ``fit_rows`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)  # bounded, so a broadcast is safe
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    sample = written(own.join(F.broadcast(known), "_id").repartition(8), "toxicity-sample")

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    least = max(3, toxic // 200)
    often = _counts(sample.where("toxic = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "stem").limit(most_stems)
    often = {r["stem"]: r["n"] for r in often.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(often))
    seldom = {r["stem"]: r["n"] for r in _counts(sample.where("toxic = 0"), wanted).collect()}
    stems = {}
    for w, a in often.items():
        b = seldom.get(w, 0)
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        share = (a + b) / max(toxic + clean, 1)
        gain = 2 * (a * math.log(max(a, 1e-9) / (toxic * share)) + (b * math.log(b / (clean * share)) if b else 0))
        if odds >= 2 and gain >= 25:
            stems[w] = odds
    grammar = Grammar(stems)
    if not toxic or not clean:
        weights = np.zeros(FEATURES)
        weights[:PATTERNS], weights[-1] = 1.0, -2.5
        return Model(grammar, weights)
    shared = spark.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in sliced(batches, 1 << 21):
            values = shared.value.features(texts_of(batch)).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * FEATURES)
            yield pa.record_batch([batch.column("toxic"), pa.ListArray.from_arrays(ends, pa.array(values))], ["toxic", "x"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of tasks
    return Model(grammar, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxicity`` from 0 to 1 (an input column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "toxicity"]

    def run(batches):
        for batch in sliced(batches, 1 << 21):
            scores = pa.array(shared.value.scores(texts_of(batch)), pa.float64())
            yield pa.record_batch([*(batch.column(c) for c in names), scores], [*names, "toxicity"])

    kept = docs.select(*[docs[c] for c in names])
    return kept.mapInArrow(run, kept.withColumn("toxicity", F.lit(0.0)).schema)


def reject_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, 1 << 21):
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch)) < least))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a grammar learned from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
