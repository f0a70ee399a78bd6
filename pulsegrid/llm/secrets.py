"""Secrets in documents: a random forest that removes false findings of a wide search.

Candidates are runs of key characters, `shortest` long or longer, that hold a digit or change from lower to upper case twice, runs of
letters of 16 characters and more, and, of any length and any characters, values given to a name such as `password` and keys of a
provider's format. Each gets features: length, kinds of characters, entropy; how usual its character transitions are, against
those of all texts; how much of it is made of dictionary words, the commonest words of all texts; what its path says (hash of the source);
the words before and after it; and how it is given to a name that says it is secret, openly by a colon, or in code. That name is none
of the neighbouring words.

Labelled findings are a table (doc_id, start, secret). Where none is given, name, provider's format and recurrence label: what has such a name or format
is a secret, unless it is a dictionary word or stands in `recurring` distinct surroundings; such values, addresses and numbers are
none. So that the name does not repeat the label, it is hidden from a half of the labelled secrets and shown
for a half of the others, and up to `common` dictionary words among dictionary words, half of them given to a name, are labelled as none.
The forest judges all candidates, also those that have a label.

Fitted on at most `sample` distinct labelled findings of each kind, those with the smallest hashes, found from counts of hash ranges. Transitions and words are
counted over all documents, and candidates come from all of them, whole. A run that is a piece of a given value stays a candidate
beside it; only the same place is not listed twice.

Null and empty texts have no candidates; a null source is a path of its own; repeated rows have their findings each.
Without labels of both kinds every candidate gets the share of secrets among the labels, 0 if there are none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import Scratch, slices, text_bytes
from pulsegrid.llm.words import LOWER, joined

SLICE = 4 << 20
SAMPLE = 20_000
WORDS = 20_000
COMMON = 2_000
RECURRING = 5
_LONG = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=.@-]+")
_HUMP = re.compile(r"[a-z][A-Z]")
_EDGE = "=./-_+@"
_LETTERS = re.compile(r"[a-z]+")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)[\"'`]?\s*(?:=|:|=>|:=)\s*(?:\"{3}|'{3}|[\"'`])?$")
_WORD = re.compile(r"\w+")
# Names to which secrets are assigned, values that stand for one, and a provider's format.
_SECRET_NAMES = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key)s?"
_NAMES = re.compile(_SECRET_NAMES + "$", re.I)
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*+|<[^>]*>|\$\{[^}]*\}|none|null|nil|true|false|changeme|example|placeholder)", re.I)
_FORMAT = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
# The value such a name is given: up to its closing quote, else up to a space or the next name with a value.
_GIVEN = re.compile(
    _SECRET_NAMES + r"""["'`]?\s*(?>:=|=>|=|:)(?!=)\s*(?:(?P<quote>"{3}|'{3}|["'`])(?P<quoted>(?:(?!(?P=quote))[^\\\n]|\\.)*)(?P=quote)"""
    r"""|["'`]?(?P<bare>(?:(?![&,;?]["'`]?[\w-]+["'`]?[=:])\S)+))""",
    re.I,
)
_HASHED = 16
FOUND = "doc_id long, start long, length long, value string, features array<double>, label int, around long"
# Where a feature says how a value is given to a name: not at all, openly by a colon, in code.
_GIVEN_AT = 13


def _classes() -> np.ndarray:
    """26 letters, digits, other signs."""
    out = np.full(256, 27, np.int64)
    for c in range(97, 123):
        out[c] = out[c - 32] = c - 97
    out[48:58] = 26
    return out


_CLASS = _classes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of letters with their counts, and pairs of following classes of characters as terms of their own."""
    pairs = np.zeros(28 * 28, np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            raw, starts = joined(part.column(0))
            kinds = _CLASS[raw]
            follow = kinds[:-1] * 28 + kinds[1:]
            pairs += np.bincount(follow, minlength=28 * 28)
            pairs -= np.bincount(follow[starts[1:-1] - 1], minlength=28 * 28)  # from one text to the next
            lower = LOWER[raw]
            lower[~((lower >= 97) & (lower <= 122))] = 32
            text = pa.array([lower.tobytes().decode("ascii")], pa.large_string())
            counts = pc.value_counts(pc.ascii_split_whitespace(text).values)
            words, n = counts.field(0), counts.field(1)
            keep = pc.greater_equal(pc.binary_length(words), 3)
            yield pa.RecordBatch.from_arrays([words.filter(keep).cast(pa.string()), n.filter(keep)], ["term", "n"])
    terms = pa.array([f"#{i}" for i in range(len(pairs))], pa.string())
    yield pa.RecordBatch.from_arrays([terms, pa.array(pairs)], ["term", "n"])


def language(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, frozenset[str]]:
    """Logarithms of the shares of transitions, and the `words` commonest words, of all documents."""
    counts = docs.select("text").mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("pair", F.startswith("term", F.lit("#")))
    best = counts.where("NOT pair").orderBy(F.desc("n"), "term").limit(words)
    table = np.ones((28, 28))
    for term, n in counts.where("pair").select("term", "n").collect():  # 784 rows
        table[divmod(int(term[1:]), 28)] += n
    return np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r["term"] for r in best.select("term").collect())


def coverage(value: str, words: frozenset[str], longest: int = 20) -> float:
    """The share of the letters of a value that dictionary words cover, the longest first from the left."""
    total = covered = 0
    for run in _LETTERS.findall(value.lower()):
        total += len(run)
        at = 0
        while at < len(run):
            for end in range(min(len(run), at + longest), at + 2, -1):
                if run[at:end] in words:
                    covered += end - at
                    at = end
                    break
            else:
                at += 1
    return covered / total if total else 0.0


def _bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.lower()) % _HASHED


def describe(value: str, before: str, after: str, path: str | None, logs: np.ndarray, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = _CLASS[np.frombuffer(text_bytes(value), np.uint8)]
    counts = np.array(list(Counter(value).values())) / n
    digits, upper = sum(c.isdigit() for c in value), sum(c.isupper() for c in value)
    letters = sum(c.isalpha() for c in value)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in value)
    usual = float(logs[kinds[:-1], kinds[1:]].mean()) if len(kinds) > 1 else 0.0
    changes = float((np.diff(kinds // 26) != 0).mean()) if len(kinds) > 1 else 0.0
    named = _named(before)
    given = 0.0 if not named else 1.0 if re.fullmatch(r"\s*:\s+", before[named.end(1) :]) else 2.0
    near = [0.0] * (2 * _HASHED)
    left, right = _WORD.findall(before[: named.start(1)] if named else before)[-2:], _WORD.findall(after)[:1]
    for word in left:
        near[_bucket(word)] += 1
    for word in right:
        near[_HASHED + _bucket(word)] += 1
    return [
        float(np.log(n)), digits / n, upper / n, letters / n, hexa / n, float(-(counts * np.log2(counts)).sum()), usual, changes,
        coverage(value, words), float("@" in value), float("/" in value), float("." in value), 1 - (digits + letters) / n, given,
        float(_bucket(path or "")), *near,
    ]


def _named(before: str) -> re.Match | None:
    """The name that says that the value after it is secret."""
    name = _NAME.search(before)
    return name if name and _NAMES.search(name[1]) else None


def sure_label(value: str, before: str, words: frozenset[str]) -> int | None:
    """1 or 0 for a finding of which name, format or the dictionary say so."""
    if _FORMAT.fullmatch(value):
        return 1
    if value.lower() in words or _PLACEHOLDER.fullmatch(value):
        return 0
    if _named(before):
        return 1
    if "@" in value or value.replace(".", "").replace("-", "").isdigit():
        return 0
    return None


def _given(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of what is given to a name that says it is secret."""
    for found in _GIVEN.finditer(text):
        if found["quote"]:
            begin, value = found.start("quoted"), found["quoted"]
        else:
            begin, value = found.start("bare"), found["bare"].rstrip("\"'`,;.")
            while value and value[-1] in ")]}" and value.count(value[-1]) > value.count("([{"[")]}".index(value[-1])]):
                value = value[:-1].rstrip("\"'`,;.")
        if value:
            yield begin, value


def _runs(text: str, shortest: int) -> Iterator[tuple[int, str]]:
    for found in _RUN.finditer(text):
        value = found.group().strip(_EDGE)
        begin = found.start() + found.group().index(value) if value else found.start()
        # A name that is assigned without a space is not part of the value.
        head, sign, tail = value.rpartition("=")
        if sign and len(tail) >= shortest:
            begin, value = begin + len(head) + 1, tail
        if len(value) >= shortest and (any(c.isdigit() for c in value) or len(_HUMP.findall(value)) > 1):
            yield begin, value
        elif len(value) >= _LONG and value.isalpha():
            yield begin, value


def candidates(text: str, shortest: int) -> list[tuple[int, str]]:
    """(start, value) in the order of places."""
    found = {*_runs(text, shortest), *_given(text), *((m.start(), m.group()) for m in _FORMAT.finditer(text))}
    return sorted(found)


def _find(shortest: int, logs: np.ndarray, words: frozenset[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for begin, value in candidates(text or "", shortest):
                    before, after = text[max(0, begin - 60) : begin], text[begin + len(value) : begin + len(value) + 40]
                    row = describe(value, before, after, path, logs, words)
                    around = xxhash.xxh3_64_intdigest(text_bytes(before[-20:] + "\0" + after[:20])) >> 1
                    rows.append((doc_id, begin, len(value), value, row, sure_label(value, before, words), around))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "value", "features", "label", "around"]
            )

    return run


def _language_and_candidates(docs: DataFrame, shortest: int) -> tuple[DataFrame, np.ndarray, frozenset[str]]:
    logs, words = language(docs)
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path"))
    return source.mapInArrow(_find(shortest, logs, words), FOUND), logs, words


def find_candidates(docs: DataFrame, shortest: int = 8) -> DataFrame:
    """doc_id, start and length in characters, value, features, the label of findings that have one by themselves, and a hash of the surroundings."""
    return _language_and_candidates(docs, shortest)[0]


def recurring_values(found: DataFrame, times: int) -> DataFrame:
    """value: those that stand in so many distinct surroundings, which copies of a document do not add to."""
    places = found.where("label = 1").groupBy("value", "around").agg(F.lit(1).alias("one"))
    return places.groupBy("value").agg(F.count("one").alias("n")).where(F.col("n") >= times).select("value")


def smallest_hashes(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of each label, those with the most leading zeros in column `hash`; 64 counts a label come to the driver."""
    zeros = F.lit(64) - F.length(F.bin("hash"))
    counts = rows.groupBy("label", zeros.alias("zeros")).agg(F.count("*").alias("n")).collect()
    floors = {}
    for label in {r["label"] for r in counts}:
        total, floors[label] = 0, 0
        for zero, n in sorted(((r["zeros"], r["n"]) for r in counts if r["label"] == label), reverse=True):
            total += n
            if total > limit:
                floors[label] = zero + 1
                break
    kept = F.lit(False)
    for label, floor in floors.items():
        kept = kept | ((F.col("label") == label) & (zeros >= floor))
    return rows.where(kept)


def common_words(logs: np.ndarray, words: frozenset[str], most: int) -> list[tuple[float, list[float]]]:
    """(0, features) of dictionary words among dictionary words, every other one given to a name."""
    order = sorted(words, key=lambda word: (xxhash.xxh64_intdigest(word), word))[:most]
    rows = []
    for i, word in enumerate(order):
        before = f"{order[i - 1]} {order[i - 2]} " + ("token: " if i % 2 else "")
        rows.append((0.0, describe(word, before, " " + order[i - 3], word, logs, words)))
    return rows


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    shortest: int = 8,
    sample: int = SAMPLE,
    trees: int = 30,
    threshold: float = 0.5,
    common: int = COMMON,
    recurring: int = RECURRING,
) -> DataFrame:
    """doc_id, start, length, value, score and secret (score at the threshold or above) of every candidate."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    candidates_, logs, words = _language_and_candidates(docs, shortest)
    found = scratch.write(candidates_, "found")
    at = F.col("features")[_GIVEN_AT]
    if findings is not None:
        given = findings.select("doc_id", "start", F.col("secret").cast("int").alias("given")).dropDuplicates(["doc_id", "start"])
        labelled = found.join(given, ["doc_id", "start"]).withColumn("label", F.col("given")).where("label IS NOT NULL")
        labelled = labelled.select("label", "value", "features")
    else:
        labelled = found.where("label IS NOT NULL").select("label", "value", "features")
        often = recurring_values(found, recurring).withColumn("often", F.lit(True))
        labelled = labelled.join(often, "value", "left").withColumn("label", F.when(F.col("often"), 0).otherwise(F.col("label"))).drop("often")
        # The name does not tell the label: hidden from half of the secrets, shown for half of the others.
        half = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(2)) == 0
        shown = F.when((F.col("label") == 1) & half, 0.0).when((F.col("label") == 0) & half & (at == 0), 1.0).otherwise(at)
        parts = [F.slice("features", 1, _GIVEN_AT), F.array(shown), F.slice("features", _GIVEN_AT + 2, 1000)]
        labelled = labelled.withColumn("features", F.concat(*parts))
    labelled = labelled.withColumn("hash", F.xxhash64("label", "value", "features")).dropDuplicates(["hash"])
    few = smallest_hashes(scratch.write(labelled, "labelled"), sample)
    fitted = few.select(F.col("label").cast("double").alias("label"), "features")
    if findings is None and words:
        fitted = fitted.unionByName(spark.createDataFrame(common_words(logs, words, common), "label double, features array<double>"))
    fitted = scratch.write(fitted.select("label", array_to_vector("features").alias("vector")).coalesce(1), "fitted")  # two bounded samples
    shares = {r["label"]: r["n"] for r in fitted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    columns = ["doc_id", "start", "length", "value"]
    if len(shares) < 2:
        score = F.lit(1.0 if 1.0 in shares else 0.0)
        return found.select(*columns, score.alias("score")).withColumn("secret", F.col("score") >= threshold)
    weight = F.when(F.col("label") == 1, 1 / shares[1.0]).otherwise(1 / shares[0.0]) * (sum(shares.values()) / 2)
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=8, seed=1, probabilityCol="share"
    )
    model = forest.fit(fitted.withColumn("weight", weight))
    judged = model.transform(found.withColumn("vector", array_to_vector("features")))
    return judged.select(*columns, vector_to_array("share")[1].alias("score")).withColumn("secret", F.col("score") >= threshold)
