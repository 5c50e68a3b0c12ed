"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each vocabulary piece.  A word's likelihood is the sum over all its segmentations
into pieces (a forward recursion over its characters, so no single segmentation is picked), a text's the product over its
words.  Piece probabilities start from how often pieces occur inside the training words and take one expectation step
(forward-backward counts over all segmentations).

Training texts are thinned to about ``most`` for each language by a hash of the row; all texts are scored.  Words are
whole runs of letters of the lower-cased text and begin with the vocabulary's word mark.  Scores are posterior probabilities under equal priors.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is everything when there is no training
text.  Rows are independent (repeated rows, null ids and further columns change nothing); ties go to the first language
in alphabetical order.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bpe import vocabulary
from pointweave.llm.text import doc_texts, slices
from pointweave.plans.lineage import cut, drop

PIECES = "piece_bpe_32k.model"
#: A vocabulary with a longer piece (in characters with the word mark) is refused; all shorter pieces are used.
LONGEST = 64
#: Training texts for each language (expected).
MOST = 3000
#: Distinct chunks (some 200 bytes each) that a worker remembers.
MEMO = 200_000
FOLDS, FOLD = 3, 1
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def load_pieces(name: str = PIECES) -> dict[str, int]:
    """Lower-case letter pieces of the vocabulary, with or without the word mark, numbered from 1; 0 is any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    kept = sorted(p for p in found if p == p.lower() and (p == _MARK or p.replace(_MARK, "", 1).isalpha()))
    if max(map(len, kept), default=0) > LONGEST:
        raise ValueError(f"{name} has a piece of more than {LONGEST} characters")
    return {p: k + 1 for k, p in enumerate(kept)}


_PIECES: dict[str, dict[str, int]] = {}


def _pieces(name: str) -> dict[str, int]:
    if name not in _PIECES:
        _PIECES[name] = load_pieces(name)
    return _PIECES[name]


def arcs(word: str, pieces: dict[str, int]) -> list[tuple[int, int, int]]:
    """``(start, end, piece)`` for every piece inside the marked word; a character that is no piece is piece 0."""
    n, out, get, most = len(word), [], pieces.get, tree(pieces).longest
    for i in range(n):
        out.append((i, i + 1, get(word[i], 0)))
        for j in range(i + 2, min(n, i + most) + 1):
            k = get(word[i:j])
            if k is not None:
                out.append((i, j, k))
    return out


def letter_words(chunk: str) -> list[str]:
    return [_MARK + w for w in _LETTERS.findall(chunk)]


#: Words of up to so many characters advance together; longer ones, which are rare, one by one.
SHORT = 64
#: Words that advance together.
TOGETHER = 20_000


class Tree:
    """The prefix tree of the pieces as arrays: all words take a step from state to state at once.

    State 0 is the root and, as a target, the end of the road; ``piece`` has the number of the piece that a state spells, or 0.
    """

    def __init__(self, pieces: dict[str, int]):
        self.letters = np.zeros(0x110000, np.int64)
        for k, c in enumerate(sorted(set().union(*pieces)), 1):
            self.letters[ord(c)] = k
        self.longest = max(map(len, pieces), default=1)
        self.width = int(self.letters.max(initial=0)) + 1
        states = {"": 0}
        for x in sorted(pieces):
            for k in range(1, len(x) + 1):
                states.setdefault(x[:k], len(states))
        self.piece = np.array([pieces.get(x, 0) for x in states], np.int64)
        steps = sorted((states[x[:-1]] * self.width + int(self.letters[ord(x[-1])]), k) for x, k in states.items() if x)
        self.keys, self.targets = (np.array(c, np.int64) for c in zip(*steps, strict=True))

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state * self.width + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], 0)


_TREES: list[tuple[dict[str, int], Tree]] = []


def tree(pieces: dict[str, int]) -> Tree:
    """The tree of a vocabulary; kept for the one used last."""
    if not _TREES or _TREES[0][0] is not pieces:
        _TREES[:] = [(pieces, Tree(pieces))]
    return _TREES[0][1]


def forward(words: list[str], pieces: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Log-likelihoods, one row for each word and one column for each language; ``p`` has a row for each piece."""
    out = np.zeros((len(words), p.shape[1]))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    short = [k for k in order if len(words[k]) <= SHORT]
    for k in order[len(short) :]:
        out[k] = forward_long(words[k], pieces, p)
    known = tree(pieces)
    most = known.longest
    for begin in range(0, len(short), TOGETHER):
        members = short[begin : begin + TOGETHER]
        lengths = np.array([len(words[k]) for k in members])
        longest = int(lengths[-1])
        codes = np.array([words[k] for k in members], f"<U{max(longest, 1)}").view(np.uint32).reshape(len(members), -1)
        letters = known.letters[codes]  # 0 beyond a word's end, where no road leads
        sums = np.zeros((most + 1, len(members), p.shape[1]))  # of the place at hand and the ``most`` places after it
        sums[0] = 1.0
        log_scale = np.zeros((len(members), 1))
        found = np.zeros((len(members), p.shape[1]))
        for i in range(longest + 1):
            here = sums[i % (most + 1)]
            if i and i % 20 == 0:  # keep long words in range
                top = np.maximum(here.max(axis=1, keepdims=True), 1e-300)
                sums /= top
                log_scale += np.log(top)
            done, live = np.searchsorted(lengths, [i, i + 1])
            found[done:live] = np.log(here[done:live]) + log_scale[done:live]
            rows, state = np.arange(live, len(members)), np.zeros(len(members) - live, np.int64)
            for j in range(i + 1, min(longest, i + most) + 1):
                if not len(rows):
                    break
                state = known.step(state, letters[rows, j - 1])
                piece = known.piece[state]
                spelt = np.flatnonzero(piece) if j > i + 1 else np.arange(len(rows))  # one character may be no piece
                sums[j % (most + 1), rows[spelt]] += here[rows[spelt]] * p[piece[spelt]]
                on = np.flatnonzero(state)
                rows, state = rows[on], state[on]
            here[:] = 0.0
        out[members] = found
    return out


def forward_long(word: str, pieces: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Log-likelihoods of one word of any length, a row with a column for each language; in memory bounded by the longest piece."""
    n, get, most = len(word), pieces.get, tree(pieces).longest
    sums = np.zeros((most + 1, p.shape[1]))  # of the place at hand and the ``most`` places after it
    sums[0] = 1.0
    log_scale = np.zeros(p.shape[1])
    for i in range(n):
        if i % 16 == 15:  # keep the sums in range, each language's by itself
            top = sums.max(0)
            sums /= top
            log_scale += np.log(top)
        here = sums[i % (most + 1)].copy()
        sums[i % (most + 1)] = 0.0
        for j in range(i + 1, min(n, i + most) + 1):
            k = get(word[i:j], 0)
            if k or j == i + 1:  # one character may be no piece
                sums[j % (most + 1)] += here * p[k]
    return np.log(np.maximum(sums[n % (most + 1)], 1e-300)) + log_scale


def expected_counts(word: str, pieces: dict[str, int], p: np.ndarray) -> list[tuple[int, float]]:
    """Posterior piece counts of a word over all segmentations, under one language's probabilities."""
    a = arcs(word, pieces)
    n = len(word)
    if n > SHORT:  # products of so many probabilities leave the range of a float
        return _expected_long(a, n, p)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    alpha[0] = beta[n] = 1.0
    for i, j, k in a:
        alpha[j] += alpha[i] * p[k]
    for i, j, k in reversed(a):
        beta[i] += p[k] * beta[j]
    return [(k, alpha[i] * p[k] * beta[j] / alpha[n]) for i, j, k in a] if alpha[n] > 0 else []


def _expected_long(a: list[tuple[int, int, int]], n: int, p: np.ndarray) -> list[tuple[int, float]]:
    """``expected_counts`` in logarithms."""
    log_p = np.log(p)
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i, j, k in a:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[k])
    for i, j, k in reversed(a):
        beta[i] = np.logaddexp(beta[i], log_p[k] + beta[j])
    return [(k, float(np.exp(alpha[i] + log_p[k] + beta[j] - alpha[n]))) for i, j, k in a]


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == FOLD, F.lit(False))


def train(docs: DataFrame, name: str = PIECES, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """Languages and a matrix of piece probabilities (pieces x languages): bounded by the vocabulary and the languages."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((1, 0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1_000_000, int(1_000_000 * most / sizes[lang]) + 1))])
    sample = cut(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text"), "training-texts")
    size = max(_pieces(name).values()) + 1

    def gather(model: dict[str, np.ndarray] | None):
        def run(batches):
            pieces, counts = _pieces(name), {}
            words: dict[tuple[str, str], int] = {}
            for b in slices(batches):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for w in letter_words(text.lower()):
                        words[lang, w] = words.get((lang, w), 0) + 1
            for (lang, w), n in words.items():
                into = counts.setdefault(lang, np.zeros(size))
                if model is None:
                    for _, _, k in arcs(w, pieces):
                        into[k] += n
                else:
                    for k, x in expected_counts(w, pieces, model[lang]):
                        into[k] += n * x
            for lang, c in counts.items():
                at = np.nonzero(c)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.float64())], names=["lang", "piece", "n"])

        got = sample.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        out = {lang: np.full(size, 0.1) for lang in languages}
        for lang, part in got.groupby("lang"):
            out[lang][part["piece"].to_numpy()] += part["n"].to_numpy()
        return {lang: c / c.sum() for lang, c in out.items()}

    model = gather(gather(None))
    drop(sample)
    return languages, np.stack([model[lang] for lang in languages], axis=1)


class Scorer:
    """Sums of word log-likelihoods, each distinct chunk being scored once for a worker."""

    def __init__(self, languages: list[str], p: np.ndarray, pieces: dict[str, int]):
        self.languages, self.p, self.pieces = languages, p, pieces
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)))
        self.letters = np.zeros(1024, bool)

    def _add(self, chunks: list[str]) -> None:
        start = len(self.place)
        while start + len(chunks) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        found = [letter_words(c) for c in chunks]
        flat = list({w for ws in found for w in ws})
        scored = dict(zip(flat, forward(flat, self.pieces, self.p), strict=True))
        for k, (c, ws) in enumerate(zip(chunks, found, strict=True)):
            self.place[c] = start + k
            self.letters[start + k] = bool(ws)
            self.table[start + k] = scored[ws[0]] if len(ws) == 1 else sum(scored[w] for w in ws)

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        split = [t.lower().split() for t in texts]
        if len(self.place) > MEMO:
            self.place.clear()
        new = list(set().union(*split).difference(self.place))
        if new:
            self._add(new)
        out = []
        for ws in split:
            at = np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))
            if not self.letters[at].any():
                out.append(("und", 0.0))
                continue
            total = self.table[at].sum(0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


#: The scorer of the model used last: a worker's next task goes on with the words that it knows.
_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, name: str = PIECES, most: int = MOST) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; learned from rows outside the held-out fold."""
    languages, p = train(docs, name, most)
    shared, model = docs.sparkSession.sparkContext.broadcast((languages, p)), uuid.uuid4().hex

    def run(batches):
        scorer = _SCORERS.get(model)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[model] = Scorer(*shared.value, _pieces(name))
        for b in slices(batches, 1024):
            got = scorer(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
