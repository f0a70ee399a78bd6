"""Toxicity of documents: a lexicon met through a Levenshtein automaton, and windows around what it finds.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic documents hold far more often.
Its trie is intersected with a Levenshtein automaton and made deterministic, so one table of transitions accepts every
word within an edit of a term, and all words of a slice run through it together. A hit is judged by the words around
it: whether quotation marks of its line enclose it, how many other hits its window holds, how dense they are. A logistic
regression over these sums gives the score, so hits that labels show to be quotation weigh little.

Fitted on a bounded sample: at most `sample` labelled documents, in the order of a hash of doc_id; of those that share
their smallest word triple (copies of a text) one counts. Everything else runs over all documents, whole texts.

Null and empty texts have no hits and get the score of none. Repeated rows get equal scores. Repeated labels of an id
count as toxic if one of them is; null labels do not count. Without labels of both kinds nothing can be learned: all scores are the share of
toxic labels (0 without labels). Other columns than doc_id and text are no input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import Scratch, release_held, slices

SLICE = 4 << 20
SAMPLE = 12_000
TERMS = 300
WINDOW = 12
# Letters of the beginnings of words that may be terms, and by how much (in logarithms) they must be commoner in toxic
# documents.
STEMS = range(3, 10)
STEM_ODDS, WORD_ODDS = 2.5, 2.5
# Letters in the sense of words here: letters and digits below U+0250, and everything above but punctuation and signs.
_LETTER = np.array([chr(c).isalnum() for c in range(0x250)])
_FOLD = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)
_QUOTES = np.array([ord(c) for c in "\"“”„«»"], np.uint32)


class Text:
    """The texts of a slice as code points in lower case, with their words."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        self.begin = np.cumsum(lengths) - lengths
        low = points < 0x250
        self.points = np.where(low, _FOLD[np.where(low, points, 0)], points)
        odd = (points >= 0x2000) & (points < 0x2C00) | (points >= 0x3000) & (points < 0x3040)
        inside = np.where(low, _LETTER[np.where(low, points, 0)], ~odd)
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate([[0], change])
        self.starts, self.ends = change[0::2], change[1::2]
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))

    def quoted(self, at: np.ndarray) -> np.ndarray:
        """Whether an odd number of quotation marks stands before these places in their line."""
        marks = np.flatnonzero(np.isin(self.points, _QUOTES))
        lines = np.concatenate([[-1], np.flatnonzero(self.points == 10)])
        line = lines[np.searchsorted(lines, at) - 1]
        return (np.searchsorted(marks, at) - np.searchsorted(marks, line)) % 2 == 1

    def word(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


class Lexicon:
    """Terms with weights; a term that ends with * stands for all words that begin so."""

    def __init__(self, terms: dict[str, float], edits: int = 1, shortest: int = 5):
        self.terms = list(terms)
        self.weights = np.array([terms[t] for t in self.terms])
        self._automaton(edits, shortest)

    def _automaton(self, edits: int, shortest: int) -> None:
        children: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}
        stems: dict[int, int] = {}
        for number, term in enumerate(self.terms):
            node = 0
            for letter in term.rstrip("*"):
                if letter not in children[node]:
                    children.append({})
                    children[node][letter] = len(children) - 1
                node = children[node][letter]
            (stems if term.endswith("*") else whole).setdefault(node, number)

        def closed(states: set) -> frozenset:
            """With the letters of terms left out, and with stems that are complete."""
            todo = list(states)
            while todo:
                node, errors = todo.pop()
                if errors == 0 and node in stems:
                    return frozenset([(-1 - stems[node], 0)])
                if 0 <= node and errors < edits:
                    for child in children[node].values():
                        if (child, errors + 1) not in states:
                            states.add((child, errors + 1))
                            todo.append((child, errors + 1))
            # A node with fewer errors stands for itself with more.
            least: dict[int, int] = {}
            for node, errors in states:
                least[node] = min(errors, least.get(node, errors))
            return frozenset(least.items())

        def step(states: frozenset, letter: str | None) -> frozenset:
            out = set()
            for node, errors in states:
                if node < 0:
                    return states
                if letter in children[node]:
                    out.add((children[node][letter], errors))
                if errors < edits:
                    out.add((node, errors + 1))
                    out.update((child, errors + 1) for child in children[node].values())
            return closed(out)

        letters = sorted({c for level in children for c in level})
        self.classes = np.zeros(0x250, np.int64)
        beyond = []
        for i, letter in enumerate(letters):
            if ord(letter) < 0x250:
                self.classes[ord(letter)] = i + 1
            else:
                beyond.append((ord(letter), i + 1))
        self.beyond = np.array(sorted(beyond), np.int64).reshape(-1, 2)
        numbers = {frozenset(): 0}
        start = closed({(0, 0)})
        numbers[start] = 1
        order, table = [frozenset(), start], []
        done = 0
        while done < len(order):
            row = []
            for letter in [None, *letters]:
                target = step(order[done], letter)
                if target not in numbers:
                    numbers[target] = len(order)
                    order.append(target)
                row.append(numbers[target])
            table.append(row)
            done += 1
        self.table = np.array(table, np.int32)
        # Of each state: the term it accepts, -1 for none, and the edits.
        self.term, self.errors = np.full(len(order), -1), np.zeros(len(order), np.int64)
        for i, states in enumerate(order):
            accepted = [(0, -1 - n) for n, _ in states if n < 0]
            accepted += [
                (e, whole[n]) for n, e in states if n in whole and (e == 0 or len(self.terms[whole[n]]) >= shortest)
            ]
            if accepted:
                self.errors[i], self.term[i] = min(accepted)

    def _class(self, points: np.ndarray) -> np.ndarray:
        low = points < 0x250
        out = np.where(low, self.classes[np.where(low, points, 0)], 0)
        if len(self.beyond):
            at = np.minimum(np.searchsorted(self.beyond[:, 0], points), len(self.beyond) - 1)
            out = np.where(self.beyond[at, 0] == points, self.beyond[at, 1], out)
        return out

    def hits(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of all words the automaton accepts."""
        state = np.ones(len(text.starts), np.int32)
        lengths = text.ends - text.starts
        alive, at = np.arange(len(state)), 0
        while len(alive):
            now = self.table[state[alive], self._class(text.points[text.starts[alive] + at])]
            state[alive] = now
            at += 1
            alive = alive[(now > 0) & (lengths[alive] > at)]
        words = np.flatnonzero(self.term[state] >= 0)
        return words, self.term[state[words]], self.errors[state[words]]


FEATURES = 8


def features(text: Text, lexicon: Lexicon, window: int = WINDOW) -> np.ndarray:
    """One row per text: what its hits and their windows sum up to."""
    n = len(text.begin)
    out = np.zeros((n, FEATURES))
    words, terms, errors = lexicon.hits(text)
    if not len(words):
        return out
    doc = np.searchsorted(text.first, words, side="right") - 1
    weight = np.maximum(lexicon.weights[terms], 0)
    quoted = text.quoted(text.starts[words])
    # Other hits among the `window` words on either side, in the same document.
    low = np.maximum(words - window, text.first[doc])
    high = np.minimum(words + window, text.first[doc + 1] - 1)
    near = np.searchsorted(words, high, side="right") - np.searchsorted(words, low) - 1
    exact = errors == 0

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, minlength=n)

    out[:, 0] = np.log1p(total(weight * (exact & ~quoted)))
    out[:, 1] = np.log1p(total(weight * (exact & quoted)))
    out[:, 2] = np.log1p(total(weight * (~exact & ~quoted)))
    out[:, 3] = np.log1p(total(weight * (~exact & quoted)))
    out[:, 4] = np.log1p(total(np.minimum(near, 4) * ~quoted))
    out[:, 5] = np.log1p(total(1.0 * ~quoted) * 200 / np.maximum(np.diff(text.first), 20))
    pairs = np.unique(np.stack([doc, terms]), axis=1)
    out[:, 6] = np.log1p(np.bincount(pairs[0], minlength=n))
    out[:, 7] = np.log1p(total(1.0 * quoted))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression with a ridge, the constant last, by Newton's method."""
    x = np.column_stack([rows, np.ones(len(rows))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of three following words, which copies of a text share as a rule."""
    release_held()
    for batch in batches:
        out = []
        for value in batch.column(1).to_pylist():
            words = (value or "").split()
            triples = [hash_of(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
            out.append(min(triples))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "same"])


def hash_of(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value) >> 1


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a batch hold each word and each beginning of a word."""
    release_held()
    for batch in batches:
        counts = Counter(), Counter()
        for value, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = Text([value])
            distinct = {text.word(i) for i in range(len(text.starts))}
            held = {w for w in distinct if 3 < len(w) <= 40 and not w.isdigit()}
            held |= {w[:k] + "*" for w in held for k in STEMS if len(w) > k}
            counts[int(toxic > 0)].update(held)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ],
            ["term", "toxic", "other"],
        )


def choose_terms(found: list[tuple[str, int, int]], n_toxic: int, n_other: int, most: int) -> dict[str, float]:
    """The strongest terms; of a beginning and words that it stands for, what says more."""
    weight = {t: float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))) for t, a, b in found}
    count = {t: a for t, a, _ in found}
    chosen: dict[str, float] = {}
    covered: set[str] = set()
    # By the toxic documents a term tells times how surely; of equals the word rather than its beginning.
    for term in sorted(count, key=lambda t: (-count[t] * weight[t], t.endswith("*"), -len(t), t)):
        base = term.rstrip("*")
        shorter = {base[:k] + "*" for k in range(STEMS.start, len(base) + 1)}
        if term in covered or not shorter.isdisjoint(chosen):
            continue
        chosen[term] = weight[term]
        covered |= shorter
        if len(chosen) == most:
            break
    return chosen


class Model:
    def __init__(self, lexicon: Lexicon | None, beta: np.ndarray | None, share: float):
        self.lexicon, self.beta, self.share = lexicon, beta, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.lexicon is None:
            return np.full(len(texts), self.share)
        rows = features(Text(texts), self.lexicon)
        return 1 / (1 + np.exp(-np.clip(rows @ self.beta[:-1] + self.beta[-1], -30, 30)))


def held_out(doc_id: str = "doc_id"):
    """Rows of which labels are never learned."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, least: int = 5) -> Model:
    """A model from at most `sample` labelled documents that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    fitted = scratch.write(
        texts.select("toxic", "text").mapInArrow(_copies, "toxic int, text string, same long")
        .dropDuplicates(["same"]).select("text", "toxic"), "sample",
    )
    sizes = {bool(r["t"]): r["n"] for r in fitted.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return Model(None, None, n_toxic / max(1, n_toxic + n_other))
    counts = fitted.mapInArrow(_count_terms, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    strong = counts.where((F.col("toxic") >= least) & (odds > F.when(F.endswith("term", F.lit("*")), STEM_ODDS).otherwise(WORD_ODDS))).orderBy(F.desc(odds * F.col("toxic")), "term").limit(20 * terms)
    found = [(r["term"], r["toxic"], r["other"]) for r in strong.collect()]
    lexicon = Lexicon(choose_terms(found, n_toxic, n_other, terms))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(Text(batch.column(0).to_pylist()), lexicon)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), batch.column(1)], ["row", "toxic"]
            )

    data = fitted.mapInArrow(measure, "row array<double>, toxic int").toArrow()  # at most `sample` rows
    rows = np.array(data.column("row").to_pylist())
    y = (data.column("toxic").to_numpy() > 0).astype(float)
    return Model(lexicon, fit(rows, y), n_toxic / (n_toxic + n_other))


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text", SLICE):
                scores = model.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *part.columns[at + 1 :], pa.array(scores)],
                    [n for n in part.schema.names if n != "text"] + ["score"],
                )

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_scored(model), "doc_id long, score double")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def find_terms(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, word, term, edits, quoted of every hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = Text(part.column(1).to_pylist())
                words, terms, errors = lexicon.hits(text)
                doc = np.searchsorted(text.first, words, side="right") - 1
                ids = part.column(0).to_pylist()
                columns = [
                    pa.array([ids[d] for d in doc], pa.int64()), pa.array([text.word(w) for w in words], pa.string()),
                    pa.array([lexicon.terms[t] for t in terms], pa.string()), pa.array(errors.astype(np.int32), pa.int32()),
                    pa.array(text.quoted(text.starts[words]), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "term", "edits", "quoted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, word string, term string, edits int, quoted boolean")
