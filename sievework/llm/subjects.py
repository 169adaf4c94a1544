"""Problem 9: subject areas of each document, by calibrated classifier chains.

Training, on a bounded sample of labelled documents:

1. *Term features.* Sentences are taken as being about one subject each. Term
   weights are fitted to the noisy document labels by expectation
   maximisation, which also finds second subjects that the labels lack and
   labels that are wrong; terms that aren't clearly of one subject weigh
   nothing. Terms that mostly stand in single sentences off the subjects of
   their document, and do so with several subjects, are cues of remarks in
   passing (on another condition or on a relative).
2. *Features of a document.* For each subject the number and share of its
   on-topic and passing sentences, how often its ``OWN_TERMS`` weightiest terms
   occur, structure (numbers of sentences, paragraphs, list items) and source.
3. *Labels with noise.* What a document is about is hidden: a given label may be
   wrong and a subject may lack its label. Both rates are estimated per subject,
   with the chain, by expectation maximisation: the chain gives the probability
   of a subject from the features, the rates turn it and the given label into the
   probability that the subject is there, and that is what the chain is fitted to.
4. *Chain.* One logistic model per subject, in order of frequency, each also
   given the subjects before it, so that co-occurrence is learned; each is
   calibrated by a scale and an offset on a part held out.
5. *Decoding.* Beam search over the chain for the most probable combination of
   at most ``MOST_SUBJECTS`` subjects, for a batch of documents at once.

The model is small (its size follows from the sample, not from the corpus) and
goes to the workers, where every document is read whole, in one pass.

Edge cases: null and blank texts have no subject; without a single usable label
nothing has one; repeated labels count once; labels of unknown subjects or
documents are ignored; a null source is a source of its own; texts of any
length are scored in full.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leak import words_of

#: The sample for training: so many labelled documents at most, none longer than so many characters.
MOST_LABELLED, MOST_CHARS = 6_000, 20_000
MOST_SUBJECTS, BEAM = 2, 8
ROUNDS = 8
LEAST_CUES = 3
SOURCE_SLOTS = 32
OWN_TERMS = 24
#: Rounds of the noise model (more of them let one label stand for two subjects), and its first guess: how often a
#: subject beside another lacks its label, how often one has a wrong label, and how surely a sentence shows its subject.
NOISE_ROUNDS, LACKING, WRONG, SHOWN = 3, 0.5, 0.02, 0.7
_SENTENCE = re.compile(r"[\n\r  ]+|(?<=[.!?…])\s+")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s", re.M)
_PARAGRAPH = re.compile(r"\n\s*\n")


def sentence_terms(text: str | None) -> list[list[str]]:
    """Words and pairs of words of each sentence, without numbers and words of one or two letters (codes, particles)."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        words = [w for w in words_of(sentence) if len(w) > 2 and not w.isdigit()]
        if words:
            out.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    return out


def structure(text: str, source: str | None) -> np.ndarray:
    """Features that don't depend on words."""
    slot = np.zeros(SOURCE_SLOTS)
    slot[zlib.crc32(source.encode("utf-8", "surrogatepass")) % (SOURCE_SLOTS - 1) if source is not None else SOURCE_SLOTS - 1] = 1
    items, paragraphs = len(_ITEM.findall(text)), len(_PARAGRAPH.findall(text)) + 1
    return np.concatenate([[math.log1p(items), math.log1p(paragraphs), math.log1p(len(text)) / 10], slot])


@dataclass
class Model:
    subjects: list[str]
    vocabulary: dict[str, int]
    topic: np.ndarray  # terms × subjects, log weights
    cue: np.ndarray  # of each term, the probability that its sentence is in passing; 0 for terms that are no cue
    own: np.ndarray  # of each term, ``subject * OWN_TERMS + place`` where it is one of its subject's weightiest, else -1
    order: list[int]  # subjects in chain order
    chain: list[np.ndarray]
    scale: list[tuple[float, float]]

    def sentence_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence its text's number and the probabilities (subjects) of on topic and in passing; and counts of own terms by text."""
        ids, starts, owner = [], [], []
        get = self.vocabulary.get
        for i, text in enumerate(texts):
            for terms in sentence_terms(text):
                known = [k for k in map(get, terms) if k is not None]
                if known:
                    starts.append(len(ids))
                    ids += known
                    owner.append(i)
        s = len(self.subjects)
        if not ids:
            return np.empty(0, int), np.empty((0, s)), np.empty((0, s)), np.zeros((len(texts), s, OWN_TERMS))
        ids, starts = np.array(ids), np.array(starts)
        p = _certain(np.add.reduceat(self.topic[ids], starts, axis=0))
        # One cue alone may be a chance word: a remark has several.
        cue = self.cue[ids]
        several = np.add.reduceat((cue > 0).astype(np.int64), starts) >= LEAST_CUES
        q = np.where(several, np.maximum.reduceat(cue, starts), 0)[:, None]
        owner = np.array(owner)
        slot = self.own[ids]
        text = np.repeat(owner, np.diff(np.append(starts, len(ids))))[slot >= 0]
        counts = np.bincount(text * (s * OWN_TERMS) + slot[slot >= 0], minlength=len(texts) * s * OWN_TERMS)
        return owner, p * (1 - q), p * q, counts.reshape(len(texts), s, OWN_TERMS)

    def features(self, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
        """Documents × subjects × features."""
        owner, on, passing, own = self.sentence_scores(texts)
        n, s = len(texts), len(self.subjects)
        counts = []
        for p in (on, passing):
            sure = np.where(p > 0.6, p, 0)
            total = np.zeros((n, s))
            np.add.at(total, owner, sure)
            counts.append(total)
        evidence, aside = counts
        total = evidence.sum(1, keepdims=True)
        rest = np.stack([np.delete(evidence, k, 1).max(1) for k in range(s)], 1) if s > 1 else np.zeros((n, 1))
        per = np.stack(
            [np.log1p(evidence), evidence / np.maximum(total, 1), (evidence > 0.6) * 1.0, (evidence > 1.4) * 1.0,
             np.log1p(rest), (evidence >= rest) * (evidence > 0.6), np.log1p(aside), np.log1p(np.broadcast_to(total, (n, s)))], 2,
        )
        shape = np.stack([structure(t or "", c) for t, c in zip(texts, sources)]) if n else np.zeros((0, 3 + SOURCE_SLOTS))
        wide = np.broadcast_to(shape[:, None, :], (n, s, shape.shape[1]))
        return np.concatenate([per, np.log1p(own), wide, np.ones((n, s, 1))], 2)

    def decode(self, features: np.ndarray) -> list[list[int]]:
        """The most probable combination of subjects of each document, by beam search along the chain."""
        n, s, wide = features.shape
        score = np.zeros((n, 1))
        chosen = np.zeros((n, 1, s), bool)
        for k, j in enumerate(self.order):
            follow, (a, b) = self.chain[k][wide:], self.scale[k]
            z = a * ((features[:, j] @ self.chain[k][:wide])[:, None] + chosen @ follow) + b
            no = -np.logaddexp(0, z)
            # A subject that no sentence is about can't be chosen.
            more = np.where((chosen.sum(2) < MOST_SUBJECTS) & (features[:, j, :1] > 0), z, -np.inf)
            both = np.concatenate([score + no, score + more + no], 1)
            with_k = chosen.copy()
            with_k[:, :, k] = True
            grown = np.concatenate([chosen, with_k], 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(both, best, 1)
            chosen = np.take_along_axis(grown, best[:, :, None], 1)
        return [[self.order[k] for k in np.flatnonzero(row)] for row in chosen[:, 0]]

    def predict(self, texts: list[str | None], sources: list[str | None]) -> list[list[str]]:
        found = self.decode(self.features(texts, sources))
        blank = [not (t and t.strip()) for t in texts]
        return [[] if b else sorted(self.subjects[j] for j in js) for b, js in zip(blank, found)]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _certain(weights: np.ndarray) -> np.ndarray:
    """Probabilities of the subjects of a sentence; all zero where no term speaks for any."""
    p = _softmax(weights)
    return np.where(weights.max(1, keepdims=True) > 0.7, p, 0)


def _labelled_alike(ids: np.ndarray, doc: np.ndarray, mass: np.ndarray, size: int) -> np.ndarray:
    """Which terms keep to one subject by the labels as given, counting each document once."""
    pairs = np.unique(doc.astype(np.int64) * size + ids)
    doc, ids = pairs // size, pairs % size
    count = np.stack([np.bincount(ids, mass[doc, k], size) for k in range(mass.shape[1])], 1)
    usual = (count.sum(0) + 1) / (count.sum() + mass.shape[1])
    return ((count + 3 * usual) / (count.sum(1, keepdims=True) + 3)).max(1) >= 0.5


def _weights(ids: np.ndarray, owner: np.ndarray, mass: np.ndarray, size: int, purity: float) -> np.ndarray:
    """How much likelier than usual each subject is with a term, in logs; 0 for terms of no clear subject."""
    count = np.stack([np.bincount(ids, mass[owner, k], size) for k in range(mass.shape[1])], 1)
    usual = (count.sum(0) + 1) / (count.sum() + mass.shape[1])
    total = count.sum(1, keepdims=True)
    given = (count + usual) / (total + 1)
    clear = (total[:, 0] >= 2) & (given.max(1) >= purity)
    return np.where(clear[:, None], np.log(given / usual), 0)


def _cues(ids: np.ndarray, owner: np.ndarray, aside: np.ndarray, subject: np.ndarray, size: int, subjects: int) -> np.ndarray:
    """Cues of remarks in passing, from sentences known to be one or not (rows with a subject only)."""
    sure = subject[owner] >= 0
    ids, owner = ids[sure], owner[sure]
    total = np.bincount(ids, minlength=size)
    off = np.bincount(ids, aside[owner], size)
    kinds = np.zeros((size, subjects), bool)
    rows = aside[owner] > 0
    kinds[ids[rows], subject[owner[rows]]] = True
    share = off / (total + 1)
    return np.where((share >= 0.5) & (kinds.sum(1) >= min(3, subjects)), share, 0)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the offset and not penalised less."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], sources: list[str | None], labels: list[set[str]], subjects: list[str]) -> Model | None:
    """A model from documents with noisy, incomplete label sets."""
    if not texts or not subjects:
        return None
    number = {s: i for i, s in enumerate(subjects)}
    s = len(subjects)
    parts = [sentence_terms(t) for t in texts]
    seen = Counter(term for doc in parts for term in {t for sentence in doc for t in sentence})
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, c in seen.items() if c >= 2))}
    ids, sentence_of, doc_of = [], [], []
    for d, doc in enumerate(parts):
        for sentence in doc:
            known = [vocabulary[t] for t in sentence if t in vocabulary]
            if known:
                ids += known
                sentence_of += [len(doc_of)] * len(known)
                doc_of.append(d)
    if not ids:
        return None
    ids, sentence_of, doc_of = np.array(ids), np.array(sentence_of), np.array(doc_of)
    starts = np.searchsorted(sentence_of, np.arange(len(doc_of)))
    given = np.zeros((len(texts), s))
    for d, own in enumerate(labels):
        for name in own:
            if name in number:
                given[d, number[name]] = 1
    have = given.sum(1, keepdims=True)
    prior = np.log(np.where(given > 0, 0.8 / np.maximum(have, 1), 0.2 / np.maximum(s - have, 1)))[doc_of]
    mass = (given / np.maximum(have, 1))[doc_of]
    alike = _labelled_alike(ids, doc_of[sentence_of], given / np.maximum(have, 1), len(vocabulary))[:, None]
    topic = alike * _weights(ids, sentence_of, mass, len(vocabulary), 0.4)
    for k in range(ROUNDS):
        told = np.add.reduceat(topic[ids], starts, axis=0)
        topic = alike * _weights(ids, sentence_of, _softmax(told + prior), len(vocabulary), 0.4 + 0.3 * (k + 1) / ROUNDS)
    p = _certain(np.add.reduceat(topic[ids], starts, axis=0))
    subject = np.where(p.max(1) > 0.6, p.argmax(1), -1)
    spoken = np.zeros((len(texts), s))
    np.add.at(spoken, (doc_of[subject >= 0], subject[subject >= 0]), 1)
    # Off topic: the only sentence of its subject in a document that has others and isn't labelled with it.
    alone = (spoken[doc_of, subject] <= 1) & (given[doc_of, subject] == 0) & (spoken[doc_of].sum(1) >= 3)
    cue = _cues(ids, sentence_of, (alone & (subject >= 0)).astype(float), subject, len(vocabulary), s)
    seen_often = np.bincount(ids, minlength=len(vocabulary))
    own = np.full(len(vocabulary), -1)
    for k in range(s):
        worth = np.where(topic.argmax(1) == k, np.maximum(topic[:, k], 0) * np.sqrt(seen_often), 0)
        best = np.argsort(-worth, kind="stable")[:OWN_TERMS]
        best = best[worth[best] > 0]
        own[best] = k * OWN_TERMS + np.arange(len(best))
    model = Model(subjects, vocabulary, topic.astype(np.float32), cue.astype(np.float32), own, [], [], [])
    features = model.features(list(texts), sources)
    target = _noisy_chain(model, features, given)
    held = np.arange(len(texts)) % 5 == 4
    for k, j in enumerate(model.order):
        x = np.concatenate([features[:, j], target[:, model.order[:k]]], 1)
        z = x[held] @ model.chain[k][: x.shape[1]]
        y = target[held, j]
        scale = (1.0, 0.0)
        if held.any() and 0.5 < y.sum() < held.sum() - 0.5:
            a, b = _logistic(np.stack([z, np.ones(len(z))], 1), y, 0.5)
            if a > 0:
                scale = (float(a), float(b))
        model.scale.append(scale)
    return model


def _noisy_chain(model: Model, features: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Fits the chain to hidden subjects; returns the probability of each in each document of the sample.

    Starts from the sentences, each of which shows its subject with a probability
    of ``SHOWN``; a subject that no sentence is about isn't there whatever its label
    says, then and later.
    """
    n, s, wide = features.shape
    fitted = np.arange(n) % 5 != 4 if n >= 5 else np.ones(n, bool)
    spoken_of = features[:, :, 0] > 0
    prior = 1 - (1 - SHOWN) ** np.expm1(features[:, :, 0])
    lacking, wrong = np.full(s, LACKING), np.full(s, WRONG)
    for _ in range(NOISE_ROUNDS):
        there = np.where(given > 0, prior * (1 - lacking), prior * lacking)
        not_there = np.where(given > 0, (1 - prior) * wrong, (1 - prior) * (1 - wrong))
        target = spoken_of * there / np.maximum(there + not_there, 1e-12)
        # A subject lacks its label where the label went to another one, so only documents with two tell how often.
        beside = target * np.minimum(1, target.sum(1, keepdims=True) - target)
        lacking = np.full(s, np.clip((beside * (1 - given)).sum() / max(1.0, beside.sum()), 0.01, 0.9))
        wrong = np.clip(((1 - target) * given).sum(0) / np.maximum((1 - target).sum(0), 1), 1e-4, 0.2)
        model.order = [int(j) for j in np.lexsort((np.arange(s), -target.sum(0)))]
        model.chain = []
        for k, j in enumerate(model.order):
            x = np.concatenate([features[:, j], target[:, model.order[:k]]], 1)
            w = _logistic(x[fitted], target[fitted, j], 1.0)
            full = np.zeros(wide + s)
            full[: len(w)] = w
            model.chain.append(full)
            prior[:, j] = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
    return target


def training_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, chars: int = MOST_CHARS):
    """Texts, sources and label sets of at most ``most`` labelled documents, by the hash of their ids."""
    tagged = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
    rows = (
        documents.select("doc_id", "text", "source").where(F.length(F.trim("text")).between(1, chars))
        .join(tagged, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    )
    return [r["text"] for r in rows], [r["source"] for r in rows], [set(r["own"]) for r in rows]


def assign_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``(doc_id, subject)``: the subjects of every document."""
    spark = documents.sparkSession
    subjects = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())
    model = fit(*training_sample(documents, labels, most), subjects)
    source = documents.select("doc_id", "text", "source")
    kind = source.schema["doc_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"doc_id {kind}, subject string")
    shared = spark.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                found = shared.value.predict(some.column(1).to_pylist(), some.column(2).to_pylist())
                rows = pa.array([i for i, names in enumerate(found) for _ in names], pa.int64())
                names = pa.array([name for own in found for name in own], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), names], names=["doc_id", "subject"])

    return source.mapInArrow(batches, f"doc_id {kind}, subject string")
