"""Toxicity by weak supervision.

1. Voters. Word lists, both given and mined from labelled texts (words much more frequent in
   toxic ones, dealt into several lists), and patterns of writing. Each voter fires or not.
2. Generative label model. Each voter fires with one chance on toxic and another on clean
   texts. Expectation-maximisation estimates these accuracies without looking at single labels;
   voters that still go together once the class is known are correlated, and the evidence of
   such a clique is counted about once. The result is a posterior label for each text.
3. A linear classifier on the words of a text is trained on the posterior labels, and scores.

Words count as a whole and by their stems (first letters), which gathers inflected forms.

Fitted on at most ``ROWS`` labelled texts; every text is scored whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.llm.sample import bounded_sample
from docsync.llm.words import LOWER, NOT_ALNUM, chunks, hash_stems, hash_words, mix, utf8

ROWS = 8000
LISTS = 8
STEMS = (4, 5, 6)
LEAST_TEXTS, LEAST_Z, LEAST_RATIO = 5, 5.0, 3.0
CERTAIN_Z = 8.0
SKETCH = 3
EM_ROUNDS = 30
STEPS, RATE, PENALTY = 800, 0.1, 1e-3
POSITIVE = 0.7

# A general list of English insults, none a common word of another language; a voter like the mined ones.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown jerk fool "
    "imbecile cretin dimwit halfwit vermin filth garbage lowlife bastard bitch asshole shit fuck fucking retard "
    "retarded"
).split()
PATTERNS = ["shouting", "many exclamation marks", "symbols inside words", "nothing known"]


def hash_list(words: list[str]) -> np.ndarray:
    """Word hashes as :func:`hash_words` gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    return hash_words(LOWER[np.frombuffer(b"".join(raw), np.uint8)], bounds, NOT_ALNUM)[0]


def terms(data: np.ndarray, bounds: np.ndarray, sketch: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of words and stems, the text of each, and a sketch of each text.

    The sketch is the least hashes of neighbouring words; near copies mostly have it in common.
    """
    hashes, at = hash_words(data, bounds, NOT_ALNUM)
    stems, word = hash_stems(data, bounds, NOT_ALNUM, STEMS)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    if not sketch:
        return np.concatenate((hashes, stems)), np.concatenate((text, text[word])), []
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    sketches = [np.unique(pairs[a : max(b - 1, a)])[:SKETCH].tobytes() + (hashes[a:b].tobytes() if b - a < 2 else b"") for a, b in itertools.pairwise(at)]
    return np.concatenate((hashes, stems)), np.concatenate((text, text[word])), sketches


def style(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: shares of capitals, exclamation marks and inner symbols among its bytes."""

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)

    capital = (data >= 65) & (data <= 90)
    symbol = np.isin(data, np.frombuffer(b"@$*0134", np.uint8))
    inner = np.zeros(len(data), bool)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 0x80)
    inner[1:-1] = symbol[1:-1] & letter[:-2] & letter[2:]
    return np.stack([share(capital), share(data == 33), share(inner)], axis=1)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, the distinct word and stem hashes and the style of each text."""
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        words, styles, sketches = [], [], []
        for low, high in chunks(bounds):
            own, own_bounds = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
            hashes, text, sketch = terms(LOWER[own], own_bounds, sketch=True)
            sketches += sketch
            styles += [row.tobytes() for row in style(own, own_bounds)]
            order = np.argsort(text, kind="stable")
            at = np.searchsorted(text[order], np.arange(high - low + 1))
            for a, b in itertools.pairwise(at):
                words.append(np.unique(hashes[order[a:b]]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.binary()), pa.array(styles, pa.binary()), pa.array(sketches, pa.binary())],
            names=["toxic", "words", "style", "sketch"],
        )


def association(row: np.ndarray, word: np.ndarray, vocabulary: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word's presence: log odds ratio, and the signed root of the likelihood ratio.

    Half a text is added to each cell of the ratio. The root is about a z value, and unlike one
    it also holds for words that never come in clean texts.
    """
    yes, no = label.sum(), (1 - label).sum()
    a, b = np.bincount(word, label[row], vocabulary), np.bincount(word, 1 - label[row], vocabulary)
    c, d = np.maximum(yes - a, 0), np.maximum(no - b, 0)
    ratio = np.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    total = a + b + c + d
    gain = 0.0
    for cell, first, second in ((a, a + c, a + b), (b, b + d, a + b), (c, a + c, c + d), (d, b + d, c + d)):
        gain = gain + cell * np.log(np.maximum(cell, 1e-12) * total / np.maximum(first * second, 1e-12))
    return ratio, np.sign(ratio) * np.sqrt(2 * np.maximum(gain, 0))


@dataclass
class LabelModel:
    """Chances to fire on toxic and on clean texts, share of toxic texts, correlations of voters.

    A voter that doesn't fire abstains: no list is complete, so its silence tells nothing. That
    nothing fired at all is a voter of its own.
    """

    on_toxic: np.ndarray
    on_clean: np.ndarray
    prior: float
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fire = np.log(self.on_toxic / self.on_clean)
        # Correlated voters that fired together share what one of them would count.
        share = votes / (1 + votes @ self.correlation)
        score = np.log(self.prior / (1 - self.prior)) + share @ fire
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit_label_model(votes: np.ndarray, prior: float, lexical: np.ndarray) -> LabelModel:
    """EM over the votes alone; the share of toxic texts, ``prior``, is given and stays.

    ``lexical``: voters whose firing speaks for toxicity at the start.
    """
    n, k = votes.shape
    prior = float(np.clip(prior, 0.01, 0.9))
    belief = np.where(votes[:, lexical].any(axis=1), 0.9, 0.05)
    model = None
    for _ in range(EM_ROUNDS):
        yes, no = belief.sum(), (1 - belief).sum()
        on = (votes.T @ belief + 0.5) / (yes + 1)
        off = (votes.T @ (1 - belief) + 0.5) / (no + 1)
        # What is left of a vote once the class is known; its correlations bind voters.
        left = votes - (belief[:, None] * on + (1 - belief)[:, None] * off)
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-9
        corr = (left.T @ left) / n / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        model = LabelModel(on, off, prior, np.clip(corr, 0, None))
        belief = model.posterior(votes)
    return model


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None


def cast_votes(row: np.ndarray, hashes: np.ndarray, n: int, lists: list[np.ndarray], styles: np.ndarray) -> np.ndarray:
    votes = np.zeros((n, len(lists) + 1 + len(PATTERNS)))
    total = np.zeros(n)
    for i, words in enumerate([*lists, hash_list(INSULTS)]):
        hit = np.bincount(row[np.isin(hashes, words)], minlength=n)
        votes[:, i] = hit > 0
        total += hit
    votes[:, -4] = styles[:, 0] > 0.4
    votes[:, -3] = styles[:, 1] > 0.02
    votes[:, -2] = styles[:, 2] > 0.01
    votes[:, -1] = total == 0
    return votes


def logistic(row: np.ndarray, place: np.ndarray, n: int, k: int, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression on soft targets, by Adam."""
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[place], n) + theta[k], -40, 40)))
        pull = (p - target) / n
        g = np.append(np.bincount(place, pull[row], k) + PENALTY * theta[:k] / n * 10, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:k], float(theta[k])


def fit(docs: DataFrame, labels: DataFrame, limit: int = ROWS) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``.

    Null labels and ids are ignored; of several labels of a document the largest counts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("double").alias("toxic")
    )
    chosen = bounded_sample(known, "doc_id", limit)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("toxic", F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_labelled, "toxic double, words binary, style binary, sketch binary").toPandas()
    got = got.sort_values(["toxic", "words"]).reset_index(drop=True)
    # Copies would pass for independent evidence: texts of one sketch count once.
    got = got.drop_duplicates(["toxic", "sketch"]).reset_index(drop=True)
    n = len(got)
    if n == 0 or got["toxic"].nunique() < 2:
        share = float(got["toxic"].mean()) if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    size = got["words"].str.len().to_numpy() // 8
    row = np.repeat(np.arange(n), size)
    hashes = np.frombuffer(b"".join(got["words"]), np.uint64)
    vocabulary, word, texts = np.unique(hashes, return_inverse=True, return_counts=True)
    usual = texts >= LEAST_TEXTS
    label = got["toxic"].to_numpy()
    ratio, z = association(row, word, len(vocabulary), label)
    first_z = z
    mined = np.flatnonzero(usual & (z >= LEAST_Z) & (ratio >= LEAST_RATIO))
    mined = mined[np.argsort(-z[mined], kind="stable")]
    lists = [vocabulary[mined[i::LISTS]] for i in range(LISTS)]
    styles = np.frombuffer(b"".join(got["style"]), np.float64).reshape(n, 3)
    votes = cast_votes(row, hashes, n, lists, styles)
    # The given labels are two more voters, one for each class, and anchor what the classes mean.
    votes = np.concatenate((votes, np.stack([label == 1, label == 0], axis=1)), axis=1)
    lexical = np.arange(votes.shape[1]) < LISTS + 1
    model = fit_label_model(votes, float(label.mean()), lexical)
    soft = model.posterior(votes)
    # The posterior also tells which words are worth a weight.
    _, z = association(row, word, len(vocabulary), soft)
    used = np.flatnonzero(usual & (np.abs(z) >= LEAST_Z))
    number = np.full(len(vocabulary), -1)
    number[used] = np.arange(len(used))
    keep = number[word] >= 0
    # Texts with one listed word and nothing else known are rare; each listed word beyond doubt
    # also counts as such a text, with the label model's posterior for its list's vote alone.
    certain = np.isin(mined, used) & (first_z[mined] >= CERTAIN_Z)
    listed = mined[certain]
    lone = np.zeros((len(mined), votes.shape[1]))
    lone[np.arange(len(mined)), np.arange(len(mined)) % LISTS] = 1
    lone = model.posterior(lone)[certain]
    weights, bias = logistic(
        np.concatenate((row[keep], n + np.arange(len(listed)))),
        np.concatenate((number[word[keep]], number[listed])),
        n + len(listed), len(used), np.concatenate((soft, lone)),
    )
    return Model(vocabulary[used], weights, bias, model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)``, one row per row of ``docs(doc_id, text)``.

    A word or stem counts once per text. Null and wordless texts get the score of no word at all.
    ``predicted`` is 1 from a score of 0.7. Other columns are ignored.
    """
    words, weights, bias = model.words, model.weights, model.bias
    mask = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)
        maybe[words & mask] = True
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            out = np.full(batch.num_rows, bias)
            for low, high in chunks(bounds):
                own = LOWER[data[bounds[low] : bounds[high]]]
                hashes, owner, _ = terms(own, bounds[low : high + 1] - bounds[low])
                hit = np.flatnonzero(maybe[hashes & mask])
                place = np.searchsorted(words, hashes[hit])
                true = words[np.minimum(place, len(words) - 1)] == hashes[hit] if len(words) else np.zeros(0, bool)
                both = np.unique(owner[hit[true]] * np.int64(max(len(words), 1)) + place[true])
                if len(both):
                    out[low:high] += np.bincount(both // len(words), weights[both % len(words)], high - low)
            chance = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance), pa.array((chance >= POSITIVE).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels that are not held out, score all texts."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
