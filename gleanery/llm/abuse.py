"""Abusive, hateful or sexual passages, scored per document.

A classifier chain over the categories: linear models are fitted one after the
other, and each also sees the probabilities that the models before it give.
For training these come out of fold, so a later model learns from the errors
its predecessors make on unseen passages. The last model of the chain predicts
any abuse. A document's score is that of its worst passage.

Passages are sentences of the whole text. Words are read through disguises:
spaced or dotted letters are joined, look-alike digits and signs replaced,
stretched letters shortened, starred letters resolved against the words of the
training sample. Features are words and word pairs.

Labels are per document, so the abusive passage of a labelled document is
inferred: passages of clean documents give the rate of every feature among
clean text, the passage least like clean text stands for an abusive document
first, and the fitted chain re-chooses it. A labelled document whose best
passage stays unlikely is taken as wrongly labelled.

The fit uses at most ``MAX_ABUSIVE`` and ``MAX_CLEAN`` labelled documents, those
of smallest id hash, a documented bound; every document is scored in place, in
one scan without a shuffle.

Defined results: null, empty and wordless texts score 0; without labelled
documents of both kinds every score is 0; contradicting labels follow the
majority, ties are not used; redelivered labels count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ABUSIVE = 1500
MAX_CLEAN = 3000
#: Clean passages per fit: half of them those most like abuse; a third as many
#: more join once a first model has named the ones it mistakes.
MAX_CLEAN_PASSAGES = 9_000
PAIR_BITS = 17
CHAIN = ("insult", "threat", "hate", "sexual", "any")
THRESHOLD = 0.5
FOLDS = 3
ROUNDS = 2
#: Words of a window in long passages, and the words between window starts.
WINDOW = 12
STRIDE = 3
#: Least unseen probability of a labelled document's worst passage.
TRUST = 0.3

_TOKEN = re.compile(r"[\w'’*@$]+|[.!?…\n]")
_SPACED = re.compile(r"(?<!\w)\w[ .\-_]\w[ .\-_]\w(?:[ .\-_]\w)*(?!\w)")
_JOIN = re.compile(r"[ .\-_]")
#: Look-alikes of letters (fixed values).
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_STRETCH = re.compile(r"(\w)\1+")
_LETTER = re.compile(r"[^\W\d_]")
_END, _UNKNOWN, _NUMBER = 0, 1, 2


def plain_word(token: str) -> str:
    """A token without its disguise; doubled letters count as single."""
    if _LETTER.search(token) and not token.isalpha():
        token = token.translate(_LOOKALIKE)
    return _STRETCH.sub(r"\1", token.strip("'’"))


def tokens(text: str) -> list[str]:
    """Lower-case tokens of a text; sentence ends are tokens of their own."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: _JOIN.sub("", m.group()), text)
    return _TOKEN.findall(text)


class Vocabulary:
    """Ids of the plain words of the training sample."""

    def __init__(self, words: Counter, least: int = 2):
        kept = sorted(w for w, n in words.items() if n >= least)
        self.ids = {w: i + 3 for i, w in enumerate(kept)}
        self.size = len(kept) + 3
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for w in sorted(kept, key=lambda w: (-words[w], w)):
            self.by_shape.setdefault((len(w), w[0]), []).append(w)
        self.cache = {".": _END, "!": _END, "?": _END, "…": _END, "\n": _END}

    def restart(self) -> "Vocabulary":
        self.cache = {".": _END, "!": _END, "?": _END, "…": _END, "\n": _END}
        return self

    def look_up(self, token: str) -> int:
        if token.isdigit():
            return _NUMBER
        word = plain_word(token)
        found = self.ids.get(word)
        if found is None and "*" in token and token[0] != "*":
            raw = token.translate(_LOOKALIKE)
            pattern = re.compile(re.escape(raw).replace(r"\*", "."))
            found = next(
                (
                    self.ids[w]
                    for w in self.by_shape.get((len(raw), raw[0]), ())
                    if pattern.fullmatch(w)
                ),
                None,
            )
        found = _UNKNOWN if found is None else found
        if len(self.cache) < 500_000:
            self.cache[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        get, look = self.cache.get, self.look_up
        return [look(t) if (i := get(t)) is None else i for t in tokens(text)]


def passages(ids: np.ndarray, doc_starts: np.ndarray):
    """Word ids without ends, start of each passage, document of each passage."""
    doc_of = np.zeros(len(ids), np.int64)
    np.add.at(doc_of, doc_starts[(doc_starts > 0) & (doc_starts < len(ids))], 1)
    doc_of = np.cumsum(doc_of)
    word = ids != _END
    new = np.ones(len(ids), bool)
    new[1:] = ids[:-1] == _END
    new[doc_starts[doc_starts < len(ids)]] = True
    group = np.cumsum(new) - 1
    w, g, d = ids[word], group[word], doc_of[word]
    if not len(w):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return w, starts, d[starts]


def windows(starts: np.ndarray, n_words: int):
    """Whole passages, and windows of long ones: headings and lost sentence
    ends join an abusive sentence to clean text. The last window ends where its
    passage ends."""
    ends = np.r_[starts[1:], n_words]
    long = ends - starts > WINDOW + 4
    size = np.where(long, -(-(ends - starts - WINDOW) // STRIDE) + 1, 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    lo = np.repeat(starts, size) + np.minimum(step * STRIDE, np.repeat(ends - starts - WINDOW, size))
    return np.r_[starts, lo], np.r_[ends, lo + WINDOW]


def pair_codes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each word and its predecessor in the passage (0 at a start)."""
    prev = np.r_[0, words[:-1]]
    prev[starts] = 0
    with np.errstate(over="ignore"):
        h = prev.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse feature rows: words and pairs of each passage."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, starts: np.ndarray, n_words: int):
        self.n = len(starts)
        lengths = np.diff(np.r_[starts, len(words)])
        self.row = np.concatenate([np.repeat(np.arange(self.n), lengths)] * 2)
        self.col = np.concatenate([words, pairs + n_words])
        self.dim = n_words + (1 << PAIR_BITS)

    def take(self, chosen: np.ndarray) -> "Rows":
        out = object.__new__(Rows)
        where = np.full(self.n, -1)
        where[chosen] = np.arange(len(chosen))
        keep = where[self.row] >= 0
        out.n, out.dim = len(chosen), self.dim
        out.row, out.col = where[self.row[keep]], self.col[keep]
        return out


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60):
    """Logistic regression by diagonal-scaled gradient steps with L2 penalty."""
    used, col = np.unique(rows.col, return_inverse=True)
    w, v, b = np.zeros(len(used)), np.zeros(extra.shape[1]), 0.0
    gw, gv, gb = np.full(len(used), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    total = weight.sum()
    for _ in range(steps):
        z = np.bincount(rows.row, w[col], rows.n) + extra @ v + b
        r = (_sigmoid(z) - y) * weight / total
        dw = np.bincount(col, r[rows.row], len(used)) + 1e-5 * w
        dv, db = extra.T @ r + 1e-5 * v, r.sum()
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        w -= 0.5 * dw / np.sqrt(gw)
        v -= 0.5 * dv / np.sqrt(gv)
        b -= 0.5 * db / np.sqrt(gb)
    full = np.zeros(rows.dim, np.float32)
    full[used] = w
    return full, v, b


class Chain:
    """Fitted chain: one weight column per category, and links between them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        n = len(CHAIN)
        self.weights = np.zeros((vocabulary.size + (1 << PAIR_BITS), n), np.float32)
        self.links, self.bias = np.zeros((n, n)), np.zeros(n)

    def probabilities(self, words: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Category probabilities of the word windows lo:hi."""
        if not len(lo):
            return np.zeros((0, len(CHAIN)))
        pairs = pair_codes(words, starts) + self.vocabulary.size
        sums = np.zeros((len(words) + 1, len(CHAIN)))
        np.cumsum(self.weights[words] + self.weights[pairs], axis=0, dtype=np.float64, out=sums[1:])
        z = sums[hi] - sums[lo]
        p = np.zeros_like(z)
        for c in range(len(CHAIN)):
            p[:, c] = _sigmoid(z[:, c] + p[:, :c] @ self.links[c, :c] + self.bias[c])
        return p

    def score(self, texts) -> np.ndarray:
        """documents x categories: probabilities of the worst passage."""
        out = np.zeros((len(texts), len(CHAIN)))
        ids, starts, n = [], np.zeros(len(texts), np.int64), 0
        for i, t in enumerate(texts):
            starts[i] = n
            if t:
                code = self.vocabulary.encode(t)
                ids += code
                n += len(code)
        ids = np.array(ids, np.int64)
        words, first, _ = passages(ids, starts)
        if len(first):
            # documents without tokens share a start with their successor
            lo, hi = windows(first, len(words))
            owner = np.searchsorted(starts, np.flatnonzero(ids != _END)[lo], side="right") - 1
            np.maximum.at(out, owner, self.probabilities(words, first, lo, hi))
        return out


def fit_chain(sample: pd.DataFrame, seed: int = 11) -> Chain | None:
    """``sample`` has text, abusive (0/1) and category (null = not told)."""
    if sample.empty or sample["abusive"].nunique() < 2:
        return None
    seen: Counter = Counter()
    coded = [tokens(t) for t in sample["text"]]
    for toks in coded:
        seen.update({plain_word(t) for t in toks if t.isalpha()})
    vocabulary = Vocabulary(seen)
    ids, starts, n = [], [], 0
    for text in sample["text"]:
        starts.append(n)
        code = vocabulary.encode(text) + [_END]
        ids += code
        n += len(code)
    words, first, doc = passages(np.array(ids, np.int64), np.array(starts))
    rows = Rows(words, pair_codes(words, first), first, vocabulary.size)
    bad_doc = sample["abusive"].to_numpy() == 1
    bad = bad_doc[doc]
    # rates of each feature over documents, clean against abusive
    def spread(mask):
        entry = mask[rows.row]
        key = np.unique(doc[rows.row[entry]] * rows.dim + rows.col[entry])
        return np.bincount(key % rows.dim, minlength=rows.dim)

    in_bad, in_clean = spread(bad), spread(~bad)
    odds = np.log((in_bad + 0.2) / (bad_doc.sum() + 0.4)) - np.log((in_clean + 0.2) / ((~bad_doc).sum() + 0.4))
    odds = np.where(in_bad + in_clean >= 2, odds, 0)
    start_score = np.bincount(rows.row, odds[rows.col], rows.n) / np.sqrt(
        np.maximum(1, np.bincount(rows.row, minlength=rows.n))
    )
    rng = np.random.default_rng(seed)
    clean = np.flatnonzero(~bad)
    if len(clean) > MAX_CLEAN_PASSAGES:
        hard = clean[np.argsort(-start_score[clean])[: MAX_CLEAN_PASSAGES // 2]]
        rest = np.setdiff1d(clean, hard)
        clean = np.r_[hard, rng.choice(rest, MAX_CLEAN_PASSAGES - len(hard), replace=False)]
    category = sample["category"].to_numpy()
    chosen = _abusive_passages(rows, start_score, np.flatnonzero(bad), clean, doc)
    if not len(chosen):
        return None
    # clean passages of the sample that a first model takes for abuse join the fit
    both = np.r_[chosen, clean]
    y = (np.arange(len(both)) < len(chosen)).astype(float)
    w, _, b = fit_linear(rows.take(both), np.zeros((len(both), 0)), y, _weights(y), steps=30)
    suspect = np.bincount(rows.row, w[rows.col], rows.n) + b
    every = np.flatnonzero(~bad)
    clean = np.union1d(clean, every[np.argsort(-suspect[every])[: MAX_CLEAN_PASSAGES // 3]])
    return _fit_once(rows, np.r_[chosen, clean], doc, category, len(chosen), vocabulary)


def _fold(doc: np.ndarray) -> np.ndarray:
    return doc * 2654435761 % 1009 % FOLDS


def _abusive_passages(rows, score, bad_rows, clean, doc) -> np.ndarray:
    """The abusive passage of each document labelled so. Choice and trust come
    from models that have not seen the document, so a wrong label cannot
    vouch for itself."""
    trusted = np.ones(len(bad_rows), bool)
    for _ in range(ROUNDS):
        usable = bad_rows[trusted]
        order = usable[np.lexsort((-score[usable], doc[usable]))]
        if not len(order):
            return order
        chosen = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        both = np.r_[chosen, clean]
        y = (np.arange(len(both)) < len(chosen)).astype(float)
        score = np.zeros(rows.n)
        for f in range(FOLDS):
            kept = np.flatnonzero(_fold(doc[both]) != f)
            held = bad_rows[_fold(doc[bad_rows]) == f]
            if not len(held) or not y[kept].any():
                continue
            w, _, b = fit_linear(rows.take(both[kept]), np.zeros((len(kept), 0)), y[kept], _weights(y[kept]))
            sub = rows.take(held)
            score[held] = _sigmoid(np.bincount(sub.row, w[sub.col], sub.n) + b)
        worst = np.zeros(doc.max() + 1)
        np.maximum.at(worst, doc[bad_rows], score[bad_rows])
        trusted = worst[doc[bad_rows]] >= TRUST
    usable = bad_rows[trusted]
    order = usable[np.lexsort((-score[usable], doc[usable]))]
    return order[np.r_[True, doc[order][1:] != doc[order][:-1]]] if len(order) else order


def _weights(y: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Abusive passages weigh up to a tenth of all, no passage over five."""
    use = np.ones(len(y), bool) if use is None else use
    ones = max(1.0, y[use].sum())
    return np.where(y > 0, min(5.0, max(1.0, 0.1 * (use.sum() - ones) / ones)), 1.0) * use


def _fit_once(rows, chosen, doc, category, n_bad, vocabulary) -> Chain:
    part = rows.take(chosen)
    told = np.array([category[d] for d in doc[chosen]], dtype=object)
    is_bad = np.arange(len(chosen)) < n_bad
    fold = _fold(doc[chosen])
    known = np.array([isinstance(c, str) for c in told])
    chain = Chain(vocabulary)
    earlier = np.zeros((len(chosen), 0))
    for c, name in enumerate(CHAIN):
        y = is_bad.astype(float) if name == "any" else (is_bad & (told == name)).astype(float)
        use = np.ones(len(chosen), bool) if name == "any" else (~is_bad | known)
        weight = _weights(y, use)
        full, v, b = fit_linear(part, earlier, y, weight)
        chain.weights[:, c], chain.links[c, : earlier.shape[1]], chain.bias[c] = full, v, b
        if name == "any":
            break
        out = np.zeros(len(chosen))
        for f in range(FOLDS):
            held = np.flatnonzero(fold == f)
            kept = np.flatnonzero(fold != f)
            if not len(held) or not len(kept):
                continue
            wf, vf, bf = fit_linear(part.take(kept), earlier[kept], y[kept], weight[kept], steps=30)
            sub = part.take(held)
            out[held] = _sigmoid(np.bincount(sub.row, wf[sub.col], sub.n) + earlier[held] @ vf + bf)
        earlier = np.c_[earlier, out]
    return chain


def labelled_sample(documents: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Bounded sample of labelled documents: text, abusive, category."""
    votes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("abusive").isin(0, 1))
        .select("doc_id", "abusive", F.lower(F.trim("category")).alias("category"), "rater", "labelled_at")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("abusive").alias("share"), F.mode("category").alias("category"))
        .where(F.col("share") != 0.5)
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("abusive"), "category", F.xxhash64("doc_id").alias("h"))
    )
    bounded = (
        votes.where("abusive = 1").orderBy("h", "doc_id").limit(MAX_ABUSIVE)
        .unionByName(votes.where("abusive = 0").orderBy("h", "doc_id").limit(MAX_CLEAN))
    )
    return (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(bounded), "doc_id")
        .select("doc_id", "text", "abusive", "category")
        .toPandas()
        .sort_values("doc_id", ignore_index=True)
    )


def abuse_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source and the probability of each category and of any abuse."""
    chain = fit_chain(labelled_sample(documents, labels))
    fields = ", ".join(f"{c} double" for c in CHAIN)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if chain is not None:
            chain.vocabulary.restart()
        for pdf in batches:
            got = np.zeros((len(pdf), len(CHAIN))) if chain is None else chain.score(pdf["text"].tolist())
            out = pdf[["doc_id", "source"]].copy()
            for i, c in enumerate(CHAIN):
                out[c] = got[:, i]
            yield out

    return documents.select("doc_id", "source", "text").mapInPandas(scan, f"doc_id long, source string, {fields}")
