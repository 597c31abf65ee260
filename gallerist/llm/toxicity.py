"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters fire on a text or abstain: seed lexicons of four languages, patterns of punctuation, case and address, and the
   terms (words and their first 4 to 9 bytes) that tell labelled training rows apart best, each one voter.
2. The label model: sums of the votes and of their products over all documents give each voter's covariance with each
   other. The covariance of conditionally independent voters is of rank one in their class differences; labelled rows
   anchor its sign and scale. Pairs that the fit leaves with a large residue are correlated, and a voter's weight shrinks
   by the correlations it has. A known label is one voter more, whose accuracy is estimated on the rows of which the
   other voters are sure. The posterior of a text follows from the weighted log odds of its votes.
3. Posterior labels of labelled and of unlabelled training rows, weighted by how sure they are, are all that the classifier
   learns from: terms are counted by posterior mass, and a logistic regression over the best of them is fitted to the
   posteriors. An unlabelled row on which no voter with a say fires is left out, as all abstain.
4. Its bias is set so that the boundary that parts the labelled training rows best has the score THRESHOLD.

Bounds, all parameters: MAX_LABELLED labelled and MAX_UNLABELLED other training rows, in order of a hash, MAX_TERMS terms
and MAX_VOTERS mined voters, those of the highest gain; of equal gain the smaller hash. All else covers all documents and
whole texts. Null and empty texts have no terms and get the score of the bias. Without labels of both classes the seed
lexicons and set rates stand in. Labels are looked up by id, the highest of several; null ids and labels teach nothing.
Rows that repeat id and text are learnt from once and scored each; ids with several texts have each scored by itself. An
empty table gives an empty result. Only the id and the text are read, so other columns may have any names. A long text is
worked on whole, some 256 texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, written
from .shingles import _BYTE, _power, mix

MAX_LABELLED, MAX_UNLABELLED, MAX_TERMS, MAX_VOTERS = 20_000, 20_000, 4096, 96
THRESHOLD = 0.3
UNLABELLED = 0.25  # what a row without a label counts for beside one with a label
#: Common insults of English, French, Spanish and German.
SEEDS = {
    "en": "idiot moron stupid dumb fool loser pathetic scum worthless trash garbage clown disgusting jerk ugly",
    "fr": "idiot imbécile stupide connard crétin débile ordure salaud minable abruti",
    "es": "idiota imbécil estúpido tonto basura inútil asqueroso cretino payaso patético",
    "de": "idiot dummkopf blöd trottel abschaum arschloch wertlos widerlich versager dreck",
}
SECOND_PERSON = "you your yours yourself tu toi vous ton te usted du dich dein ihr"

#: Everything in ASCII but letters and digits parts words.
_APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_KINDS = (4, 5, 6, 7, 8, 9)


def _hash_words(words: str) -> np.ndarray:
    return np.unique(np.concatenate([term_hashes([w])[0] for w in words.split()]))


def term_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, kind) of every word (kind 0) and of its first 4 to 9 bytes, in lower case."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    word = ~_APART[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    lengths = ends - starts
    bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    inside = np.flatnonzero(word)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    value = _BYTE[data[inside]] * _power(int(lengths.max()))[place]
    hashes, owners, kinds = [mix(np.add.reduceat(value, first))], [owner], [np.zeros(len(owner), np.int64)]
    partial = np.zeros(len(starts), np.uint64)
    for k in range(max(_KINDS)):
        has = lengths > k
        partial[has] += value[first[has] + k]
        if k + 1 in _KINDS:
            hashes.append(mix(partial[has] + np.uint64(k + 1)))
            owners.append(owner[has])
            kinds.append(np.full(int(has.sum()), k + 1))
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(kinds)


class Lookup:
    """Places of hashes in a sorted table, with a bitmap in front."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(table >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into hashes, places in the table) of those that are in it."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.table):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.table, hashes[at]), len(self.table) - 1)
        hit = self.table[place] == hashes[at]
        return at[hit], place[hit]


def _weighed(owner: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, log of one plus the count) of each pair."""
    pairs, counts = np.unique(owner * width + place, return_counts=True)
    return pairs // width, pairs % width, np.log1p(counts)


@dataclass
class Voters:
    """Columns: the seed lexicons, second person, three patterns, then one for each mined term."""

    mined: np.ndarray  # sorted hashes
    seeds: list[np.ndarray] = field(default_factory=lambda: [_hash_words(w) for w in (*SEEDS.values(), SECOND_PERSON)])

    @property
    def count(self) -> int:
        return len(self.seeds) + 3 + len(self.mined)

    def votes(self, texts: list[str], terms=None) -> np.ndarray:
        hashes, owner, _ = terms or term_hashes(texts)
        out = np.zeros((len(texts), self.count), np.float32)
        for j, seed in enumerate(self.seeds):
            at, _ = Lookup(seed).find(hashes)
            out[owner[at], j] = 1
        n = len(self.seeds)
        for i, t in enumerate(texts):
            size = max(len(t), 1)
            out[i, n] = t.count("!") * 50 > size
            out[i, n + 1] = size > 20 and t.isupper()
            out[i, n + 2] = t.count("?!") + t.count("!?") > 0
        at, place = Lookup(self.mined).find(hashes)
        out[owner[at], n + 3 + place] = 1
        return out


@dataclass
class LabelModel:
    prior: float
    toxic: np.ndarray  # rate at which a voter fires on toxic texts
    clean: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    label: float = 0.98  # class difference of a known label: 1 would be without errors

    @classmethod
    def fit(cls, n: float, sums: np.ndarray, products: np.ndarray, n_labelled: float, n_toxic: float, fired_toxic: np.ndarray, fired: np.ndarray, rounds: int = 50) -> LabelModel:
        """n, sums, products: over all texts; the others over labelled ones, fired_toxic and fired by voter."""
        prior = float(np.clip(n_toxic / n_labelled, 0.001, 0.999))
        spread = prior * (1 - prior)
        mean = sums / max(n, 1)
        cov = products / max(n, 1) - np.outer(mean, mean)
        anchor = (fired_toxic / n_labelled - prior * fired / n_labelled) / spread  # class difference, from the labels
        difference, v = anchor.copy(), len(mean)
        trust = np.ones((v, v)) - np.eye(v)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        for _ in range(rounds):
            model = spread * np.outer(difference, difference)
            residue = (cov - model) / np.outer(sd, sd)
            trust = (np.abs(residue) < 0.05) & ~np.eye(v, dtype=bool)
            top = spread * (trust * cov) @ difference + v * spread * anchor
            low = spread * spread * (trust @ (difference * difference)) + v * spread
            difference = top / low
        rate_toxic = np.clip(mean + (1 - prior) * difference, 1e-4, 1 - 1e-4)
        rate_clean = np.clip(mean - prior * difference, 1e-4, 1 - 1e-4)
        residue = (cov - spread * np.outer(difference, difference)) / np.outer(sd, sd)
        np.fill_diagonal(residue, 0)
        residue[np.abs(residue) < 0.05] = 0
        return cls(prior, rate_toxic, rate_clean, 1 / (1 + np.abs(residue).sum(axis=1)), residue)

    @classmethod
    def without_labels(cls, voters: Voters) -> LabelModel:
        n, k = voters.count, len(SEEDS)
        toxic, clean = np.full(n, 0.1), np.full(n, 0.1)
        toxic[:k], clean[:k] = 0.5, 0.01
        return cls(0.1, toxic, clean, np.ones(n), np.zeros((n, n)))

    def posterior(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Probabilities that texts are toxic; known: 1 or 0 where a label is known, -1 elsewhere."""
        on, off = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * on) + (1 - votes) @ (self.weight * off)
        if known is not None:
            hit, false = self.prior + (1 - self.prior) * self.label, self.prior * (1 - self.label)
            odds = odds + np.where(known > 0, np.log(hit / false), np.where(known == 0, np.log((1 - hit) / (1 - false)), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def judge_label(self, votes: np.ndarray, known: np.ndarray) -> None:
        """Estimates the accuracy of known labels from the rows of which the voters alone are sure; at first one in a hundred is wrong."""
        sure = self.posterior(votes) > 0.99
        wrong = (float((known[sure] == 0).sum()) + 0.5) / (float(sure.sum()) + 50)
        self.label = float(np.clip(1 - 2 * wrong, 0.6, 0.995))

    def judged(self, votes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior, weight) of texts: how sure it is; texts without a label on which no voter with a say fires have no weight."""
        p = self.posterior(votes, known)
        heard = (votes[:, self.toxic - self.clean > 0.02] > 0).any(axis=1) | (known >= 0)
        return p, np.where(heard, np.abs(2 * p - 1), 0.0) * np.where(known >= 0, 1.0, UNLABELLED)


@dataclass
class Classifier:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        hashes, owner, _ = term_hashes(texts)
        at, place = Lookup(self.terms).find(hashes)
        rows, columns, values = _weighed(owner[at], place, max(len(self.terms), 1))
        odds = self.bias + np.bincount(rows, weights=self.weights[columns] * values, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @classmethod
    def fit(cls, terms: np.ndarray, scale: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 800, sparse: float = 1e-5) -> Classifier:
        """Logistic regression on soft targets, weighted, from sparse rows, by accelerated proximal steps with an L1 penalty.

        scale: a term that tells the classes apart with more evidence gets a larger one, and so is preferred.
        """
        n, v = len(target), len(terms)
        value = scale[columns] * values
        forward = lambda p: p[v] + np.bincount(rows, weights=p[columns] * value, minlength=n)
        backward = lambda e: np.append(np.bincount(columns, weights=e[rows] * value, minlength=v), e.sum())
        x = np.ones(v + 1)
        for _ in range(20):
            x = backward(forward(x / np.linalg.norm(x)))
        step = 4 * n / np.linalg.norm(x)
        p = np.zeros(v + 1)
        mean = float((target * weight).sum() / weight.sum())
        p[v] = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        at, t = p, 1.0
        for _ in range(steps):
            error = weight * (1 / (1 + np.exp(-np.clip(forward(at), -30, 30))) - target)
            new = at - step * backward(error) / n
            new[:v] = np.sign(new[:v]) * np.maximum(np.abs(new[:v]) - step * sparse, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at, p, t = new + (t - 1) / after * (new - p), new, after
        return cls(terms, p[:v] * scale, float(p[v]))


def boundary(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap in z among those at which the classes of the training rows part with the best F1."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    gap = np.append(z[:-1] - z[1:], 1e-9)
    at = int(np.argmax(np.where((f1 >= f1.max() - 1e-9) & (gap > 0), gap, -1.0)))
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at])


def _term_counts(rows: DataFrame, judged) -> DataFrame:
    """(term, toxic, clean): the mass of toxic and of clean rows with each term; judged: toxicity and weight of each text, from (texts, labels, terms)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            known = batch.column("toxic").to_numpy()
            for s in range(0, len(texts), 256):
                found = term_hashes(texts[s : s + 256])
                mass, weight = judged(texts[s : s + 256], known[s : s + 256], found)
                hashes, owner, _ = found
                pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
                term, at = np.unique(pairs[0], return_inverse=True)
                row = pairs[1].astype(np.int64)
                pos, neg = (np.bincount(at, weights=x[row], minlength=len(term)) for x in (weight * mass, weight * (1 - mass)))
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(neg)], names=["term", "toxic", "clean"])

    return rows.mapInArrow(run, "term long, toxic double, clean double").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _best_terms(counted: DataFrame, n_toxic: float, n_clean: float, most: int):
    """The terms with the most evidence, with their log odds."""
    counted = counted.select("term", F.round("toxic", 6).alias("toxic"), F.round("clean", 6).alias("clean")).where(F.col("toxic") + F.col("clean") >= 3)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    gain = F.round(F.abs(odds) * F.sqrt(F.col("toxic") + F.col("clean")), 9)
    return counted.select("term", "toxic", "clean", odds.alias("odds"), gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(most).toPandas()


def _moments(docs: DataFrame, voters: Voters) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of texts, sums of votes and of products of two votes, over all texts; a few rows for each task reach the shuffle."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        n, products = 0, np.zeros((voters.count, voters.count))
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for s in range(0, len(texts), 512):
                votes = voters.votes(texts[s : s + 512])
                n += len(votes)
                products += votes.T @ votes
        i, j = np.nonzero(products)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(products[i, j], float(n)))], names=["i", "j", "x"])

    found = docs.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    products, n = np.zeros((voters.count, voters.count)), 0.0
    for r in found:
        if r["i"] < 0:
            n = r["x"]
        else:
            products[r["i"], r["j"]] = r["x"]
    return n, np.diag(products).copy(), products


def _training_rows(docs: DataFrame, labelled: DataFrame, learnt: Column, max_labelled: int, max_unlabelled: int) -> DataFrame:
    """(text, toxic) of training rows: toxic is 1 or 0 where a label is known, -1 elsewhere."""
    ids = labelled.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    mark = F.xxhash64("text").alias("mark")
    rows = docs.where(F.col("id").isNotNull() & F.coalesce(learnt, F.lit(False))).select("id", mark).join(ids, "id", "left")
    rows = written(rows, "rows")
    order = [F.xxhash64("id", "mark"), "id", "mark"]
    picked = [rows.where(test).distinct().orderBy(*order).limit(most) for test, most in (("toxic IS NOT NULL", max_labelled), ("toxic IS NULL", max_unlabelled))]
    keys = picked[0].union(picked[1])
    texts = docs.select("id", mark, "text").join(F.broadcast(keys), ["id", "mark"]).dropDuplicates(["id", "mark"])
    out = written(texts.select("text", F.coalesce("toxic", F.lit(-1)).cast("long").alias("toxic")), "sample")
    drop_written(rows)
    return out


def train(
    docs: DataFrame, labelled: DataFrame, learnt: Column | bool = True, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, max_terms: int = MAX_TERMS, max_voters: int = MAX_VOTERS
) -> tuple[Voters, LabelModel, Classifier]:
    """docs: (id, text); labelled: (id, toxic), the labels to learn from; learnt, over id: the rows to learn from at all."""
    import pyarrow.compute as pc

    rows = _training_rows(docs, labelled, learnt if isinstance(learnt, Column) else F.lit(learnt), max_labelled, max_unlabelled)
    total = rows.where("toxic >= 0").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n_labelled, n_toxic = int(total["n"]), int(total["t"] or 0)
    if not n_toxic or n_toxic == n_labelled:
        voters = Voters(np.zeros(0, np.uint64))
        terms = np.unique(np.concatenate(voters.seeds[: len(SEEDS)]))
        return voters, LabelModel.without_labels(voters), Classifier(terms, np.full(len(terms), 3.0), -2.5)

    first = _best_terms(_term_counts(rows.where("toxic >= 0"), lambda texts, known, found: (known.astype(np.float64), np.ones(len(texts)))), n_toxic, n_labelled - n_toxic, max_terms)
    telling = first[(first["odds"] > 2.5) & (first["toxic"] >= 4)]["term"].to_numpy(np.int64).view(np.uint64)
    voters = Voters(np.sort(telling[:max_voters]))
    n, sums, products = _moments(docs.select("text"), voters)

    def votes_of(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for s in range(0, len(texts), 512):
                yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(v) for v in voters.votes(texts[s : s + 512])], pa.list_(pa.int32())), batch.column("toxic").slice(s, 512)], names=["votes", "toxic"])

    cast = rows.where("toxic >= 0").mapInArrow(votes_of, "votes array<int>, toxic long").toArrow()
    known = cast["toxic"].to_numpy()
    votes = np.zeros((len(known), voters.count), np.float32)
    for i, v in enumerate(cast["votes"].to_pylist()):
        votes[i, v] = 1
    model = LabelModel.fit(n, sums, products, len(known), known.sum(), (votes * known[:, None]).sum(axis=0), votes.sum(axis=0))
    model.judge_label(votes, known)

    judged = lambda texts, known, found: model.judged(voters.votes(texts, found), known)
    best = _best_terms(_term_counts(rows, judged), n_toxic, n_labelled - n_toxic, max_terms)
    hashes = best["term"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    terms, scale = hashes[by], (best["gain"] / (best["gain"] + 15.0)).to_numpy()[by] ** 2

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, known = [x or "" for x in batch.column("text").to_pylist()], batch.column("toxic").to_numpy()
            for s in range(0, len(texts), 256):
                found = term_hashes(texts[s : s + 256])
                target, weight = judged(texts[s : s + 256], known[s : s + 256], found)
                at, place = Lookup(terms).find(found[0])
                owner, place, values = _weighed(found[1][at], place, max(len(terms), 1))
                said = (weight > 0) | (known[s : s + 256] >= 0)  # the others weigh nothing and stay here
                mine = said[owner]
                cut = np.append(0, np.cumsum(np.bincount(owner[mine], minlength=len(target))[said]))
                cut = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(cut, pa.array(place[mine].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(values[mine].astype(np.float32))),
                        pa.array(known[s : s + 256][said]), pa.array(target[said]), pa.array(weight[said]),
                    ],
                    names=["places", "values", "toxic", "target", "weight"],
                )

    sample = rows.mapInArrow(run, "places array<int>, values array<float>, toxic long, target double, weight double").toArrow().combine_chunks()
    drop_written(rows)
    known, target, weight = (sample[c].to_numpy() for c in ("toxic", "target", "weight"))
    lengths = pc.list_value_length(sample["places"]).to_numpy()
    columns, values = (pc.list_flatten(sample[c]).to_numpy() for c in ("places", "values"))
    at = np.repeat(np.arange(len(lengths)), lengths)
    classifier = Classifier.fit(terms, scale, at, columns, values, target, weight)
    z = classifier.bias + np.bincount(at, weights=classifier.weights[columns] * values, minlength=len(lengths))
    classifier.bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - boundary(z[known >= 0], known[known >= 0])  # the boundary gets the score THRESHOLD
    return voters, model, classifier


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs; held_out, over the column id, tells which labels are not learnt from."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("toxic")).where(~held_out)
    _, _, classifier = train(source, known, ~F.coalesce(held_out, F.lit(False)))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = [classifier.scores(texts[s : s + 256]) for s in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "score"])

    scored = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double")
    out = scored.select("id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    return out.withColumnRenamed("id", id_col)
