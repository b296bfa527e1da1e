"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters look at words. Some hold published insults by theme, some hold words mined from labelled
   rows, some see patterns; each says toxic, clean or nothing. A given label is one more voter, of
   unknown accuracy like the others, on the rows that have one.
2. The label model is a mixture over the unseen class, fitted by expectation maximisation. Voters are
   first taken as independent given the class; those whose votes then still correlate are joined into
   cliques with a joint table each, and the model is fitted again. It yields posterior labels.
3. A logistic model over word and voter features is trained on the posterior labels and scores all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices, split_words

#: Labelled and unlabelled rows that mining, label model and classifier are fitted on, at most about so many of each.
SAMPLE_ROWS = 30_000
#: Words that the classifier weighs, and the documents a mined word stands in, at least.
FEATURE_WORDS, MIN_DOCS = 4000, 3
MINED_VOTERS = 4
THRESHOLD = 0.3
SLICE = 6 << 20

#: Common insults by theme.
LEXICONS: dict[str, list[str]] = {
    "intelligence": ["idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "imbecile", "dimwit", "fool", "brainless", "retard", "retarded"],
    "worth": ["worthless", "pathetic", "loser", "losers", "useless", "failure", "nobody"],
    "disgust": ["disgusting", "trash", "scum", "garbage", "filth", "filthy", "vermin", "vile", "gross", "pig"],
    "ridicule": ["clown", "clowns", "joke", "freak", "creep", "coward", "liar"],
}
TOXIC, CLEAN, SILENT = 1, 0, 2
TRIM = ".,;:!?\"'()[]{}<>*#$%&|"


def normal_words(words: pa.Array) -> pa.Array:
    """Lower case without marks at the ends."""
    return pc.utf8_trim(pc.utf8_lower(words), TRIM)


def learned_from(doc_id: Column) -> Column:
    """Rows that labels may be learned from: the CRC-32 of the id's text is not 2 modulo 4; a null id never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


@dataclass
class Lexicon:
    """Known words with, for each, its voter (-1: none, only a feature)."""

    words: pa.Array
    voter: np.ndarray
    n_voters: int

    @classmethod
    def of(cls, strong: list[str], features: list[str], refuted: set[str]) -> Lexicon:
        """strong words are dealt to ``MINED_VOTERS`` voters in turn; refuted ones lose their vote, as where an
        insult of one language is an everyday word of another."""
        voter: dict[str, int] = {}
        for number, listed in enumerate(LEXICONS.values()):
            voter.update({w: number for w in listed if w not in refuted})
        for i, word in enumerate(strong):
            voter.setdefault(word, len(LEXICONS) + i % MINED_VOTERS)
        words = list(dict.fromkeys([*voter, *features]))
        return cls(pa.array(words, pa.large_string()), np.array([voter.get(w, -1) for w in words]), len(LEXICONS) + MINED_VOTERS)

    #: Pattern voters behind the lexicon voters.
    PATTERNS = ("addressed", "repeated", "none_found")
    ADDRESS = ("you", "your", "you're", "ur", "u")

    @property
    def names(self) -> list[str]:
        return [*LEXICONS, *(f"mined{i}" for i in range(MINED_VOTERS)), *self.PATTERNS]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(votes of each text and voter, first feature of each text and the end, word numbers present, distinct)."""
        first, flat = split_words(texts)
        n = len(first) - 1
        coded = flat.dictionary_encode()
        normal = normal_words(coded.dictionary)
        number = pc.fill_null(pc.index_in(normal, self.words), -1).to_numpy(zero_copy_only=False)
        which = coded.indices.to_numpy()
        at = np.flatnonzero(number[which] >= 0) if len(which) else np.empty(0, np.int64)
        word = number[which[at]] if len(at) else np.empty(0, np.int64)
        doc = np.searchsorted(first, at, side="right") - 1
        pairs = np.unique(doc * len(self.words) + word)
        doc_of, present = pairs // len(self.words), pairs % len(self.words)
        votes = np.full((n, self.n_voters + len(self.PATTERNS)), SILENT, np.int8)
        by = self.voter[present]
        votes[doc_of[by >= 0], by[by >= 0]] = TOXIC
        hostile = self.voter[word] >= 0
        counts = np.bincount(doc[hostile], minlength=n)
        address = pc.is_in(normal, pa.array(self.ADDRESS, pa.large_string())).to_numpy(zero_copy_only=False)
        spoken = np.concatenate(([0], np.cumsum(address[which]))) if len(which) else np.zeros(1, np.int64)
        place, owner = at[hostile], doc[hostile]
        near = spoken[place] - spoken[np.maximum(first[owner], place - 3)] > 0 if len(place) else np.empty(0, bool)
        votes[owner[near], self.n_voters] = TOXIC
        votes[counts >= 2, self.n_voters + 1] = TOXIC
        votes[counts == 0, self.n_voters + 2] = CLEAN
        bounds = np.searchsorted(doc_of, np.arange(n + 1))
        return votes, bounds, present


# ---- label model -----------------------------------------------------------------------------------------------------


def _tables(codes: list[np.ndarray], sizes: list[int], posterior: np.ndarray, prior: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for code, size, base in zip(codes, sizes, prior):
        counts = np.stack([np.bincount(code, w, minlength=size) for w in (1 - posterior, posterior)]) + base
        out.append(counts / counts.sum(axis=1, keepdims=True))
    return out


@dataclass
class LabelModel:
    """P(votes | class) as a product of tables, one for each clique of voters."""

    cliques: list[list[int]]
    tables: list[np.ndarray]
    base: float

    @staticmethod
    def _codes(votes: np.ndarray, cliques: list[list[int]]) -> list[np.ndarray]:
        return [np.dot(votes[:, c].astype(np.int64), 3 ** np.arange(len(c))) for c in cliques]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.base / (1 - self.base)))
        for code, table in zip(self._codes(votes, self.cliques), self.tables):
            odds += np.log(table[1][code]) - np.log(table[0][code])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    @classmethod
    def _em(cls, votes: np.ndarray, cliques: list[list[int]], start: np.ndarray, rounds: int = 50) -> LabelModel:
        codes, sizes = cls._codes(votes, cliques), [3 ** len(c) for c in cliques]
        prior = [np.stack([_pseudo(c, k) for k in (CLEAN, TOXIC)]) for c in cliques]
        posterior = start
        for _ in range(rounds):
            model = cls(cliques, _tables(codes, sizes, posterior, prior), float(np.clip(posterior.mean(), 1e-3, 0.5)))
            after = model.posterior(votes)
            if np.abs(after - posterior).max() < 1e-4:
                break
            posterior = after
        return model

    @classmethod
    def fit(cls, votes: np.ndarray, joined: float = 0.15) -> LabelModel:
        """Independent voters first; then cliques of up to three voters whose correlation given the class passes ``joined``."""
        for_, against = (votes == TOXIC).sum(axis=1), (votes == CLEAN).sum(axis=1)
        start = np.where(for_ > 0, 0.5 + 0.45 * (for_ > against), 0.02)
        m = votes.shape[1]
        model = cls._em(votes, [[v] for v in range(m)], start)
        posterior = model.posterior(votes)
        said = (votes == TOXIC).astype(float) - (votes == CLEAN)
        cliques = [[v] for v in range(m)]
        for strength, a, b in sorted(((c, a, b) for a, b, c in _correlations(said, posterior)), reverse=True):
            if strength < joined:
                break
            x, y = next(c for c in cliques if a in c), next(c for c in cliques if b in c)
            if x is not y and len(x) + len(y) <= 3:
                cliques.remove(y)
                x += y
        return cls._em(votes, cliques, posterior)


def _pseudo(clique: list[int], of: int) -> np.ndarray:
    """Pseudo-counts of a clique's vote patterns: a vote for the class itself is the more likely."""
    weight = {of: 2.0, 1 - of: 0.5, SILENT: 2.0}
    codes = np.arange(3 ** len(clique))
    return 2 * np.prod([[weight[int(code // 3**i % 3)] for code in codes] for i in range(len(clique))], axis=0)


def _correlations(said: np.ndarray, posterior: np.ndarray) -> Iterator[tuple[int, int, float]]:
    strength = np.zeros((said.shape[1],) * 2)
    for w in (1 - posterior, posterior):
        share = w / max(w.sum(), 1e-9)
        centred = said - share @ said
        cov = (centred * share[:, None]).T @ centred
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        strength = np.maximum(strength, np.abs(cov / np.outer(sd, sd)) * (w.sum() > 20))
    for a in range(len(strength)):
        for b in range(a + 1, len(strength)):
            yield a, b, float(strength[a, b])


# ---- classifier ------------------------------------------------------------------------------------------------------


def fit_logistic(bounds: np.ndarray, features: np.ndarray, n: int, targets: np.ndarray, l2: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights of presence features and a bias (the last) by Adam on the cross-entropy with soft targets."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    w[-1] = np.log((targets.mean() + 1e-3) / (1 - targets.mean() + 1e-3)) if rows else -3.0
    for t in range(1, rounds + 1 if rows else 1):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[features], rows) + w[-1], -50, 50))) - targets
        grad = np.append(np.bincount(features, error[row], n) + l2 * w[:-1], error.sum()) / rows
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    label_model: LabelModel
    weights: np.ndarray

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _features(self.lexicon, *self.lexicon.read(texts))

    def score(self, texts: pa.Array) -> np.ndarray:
        bounds, features = self.features(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[features], len(texts)) + self.weights[-1], -50, 50)))


def _features(lexicon: Lexicon, votes: np.ndarray, bounds: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words present, then voters that spoke, numbered behind the words."""
    doc, voter = np.nonzero(votes != SILENT)
    row = np.concatenate((np.repeat(np.arange(len(votes)), np.diff(bounds)), doc))
    feature = np.concatenate((present, voter + len(lexicon.words)))
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(len(votes) + 1)), feature[order]


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by a hash of the id, all of them if there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def mined_words(labelled: DataFrame, least: int = MIN_DOCS) -> Mined:
    """What the words of (text, label) tell, by document counts over the sample."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                first, flat = split_words(part.column("text"))
                coded = flat.dictionary_encode()
                normal = normal_words(coded.dictionary).dictionary_encode()
                if not len(flat):
                    continue
                word = normal.indices.to_numpy()[coded.indices.to_numpy()]
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                pairs = np.unique(doc * len(normal.dictionary) + word)
                label = part.column("label").to_numpy(zero_copy_only=False)[pairs // len(normal.dictionary)]
                word = pairs % len(normal.dictionary)
                total, toxic = np.bincount(word, minlength=len(normal.dictionary)), np.bincount(word, label, len(normal.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([normal.dictionary.cast(pa.string()), pa.array(toxic), pa.array(total)], ["word", "toxic", "docs"])

    counts = labelled.select("text", "label").mapInArrow(distinct, "word string, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")).where((F.col("docs") >= least) & (F.length("word") > 1))
    counts = counts.persist()
    share = labelled.agg(F.avg("label")).first()[0] or 0.0
    surprise = F.abs(F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * (share * (1 - share) + 1e-6))
    top = counts.orderBy(surprise.desc(), "word").limit(FEATURE_WORDS).collect()
    listed = counts.where(F.col("word").isin([w for ws in LEXICONS.values() for w in ws])).collect()
    tested = counts.count()
    counts.unpersist()
    strong = sorted(((_evidence(r["toxic"], r["docs"], share), r["word"]) for r in top if r["toxic"] >= 0.6 * r["docs"]), reverse=True)
    return Mined([r["word"] for r in top], [w for e, w in strong if e > math.log(max(1, tested)) + 1], {r["word"] for r in listed if r["toxic"] < 0.3 * r["docs"]})


@dataclass
class Mined:
    """Words to weigh; those that stand in toxic documents by more than chance would do among all words tested; listed
    insults that stand in clean documents mostly."""

    features: list[str]
    strong: list[str]
    refuted: set[str]


def _evidence(toxic: int, docs: int, share: float) -> float:
    """Chernoff's exponent of so many toxic documents among those of a word, if labels fell at random."""
    rate, share = toxic / docs, min(max(share, 1e-6), 1 - 1e-6)
    side = lambda p, q: p * math.log(p / q) if p else 0.0
    return docs * (side(rate, share) + side(1 - rate, 1 - share))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """docs (id, text), labels (id, label); only rows that ``learned_from`` admits are looked at.

    Labels, and documents whose label is not looked at, are sampled by a hash of the id, about
    ``sample_rows`` of each at most: the one bound of the fit. What reaches the driver are word numbers of the sample.
    """
    admitted = docs.where(learned_from(F.col("id")))
    known = labels.where(F.col("label").isNotNull() & learned_from(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    # The sample of labels is bounded, so it goes to the texts and no text is shuffled.
    sampled = _sample(known, sample_rows)
    labelled = admitted.join(F.broadcast(sampled), "id").select("id", "text", "label")
    others = admitted.join(F.broadcast(sampled.select("id")), "id", "left_anti")
    rest = _sample(others, sample_rows).select("id", "text", F.lit(None).cast("int").alias("label"))
    found = mined_words(labelled)
    lexicon = Lexicon.of(found.strong, found.features, found.refuted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                votes, bounds, present = lexicon.read(part.column("text"))
                words = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(present.astype(np.int32)))
                said = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1]), pa.array(votes.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()) if pa.types.is_integer(part.column("id").type) else part.column("id"), part.column("label").cast(pa.int32()), words, said], ["id", "label", "words", "votes"])

    rows = labelled.unionByName(rest).withColumn("id", F.col("id").cast("string")).withColumn("label", F.col("label").cast("int"))
    table = rows.select("id", "text", "label").mapInArrow(read, "id string, label int, words array<int>, votes array<int>").toArrow().sort_by("id").combine_chunks()
    label = pc.fill_null(table.column("label"), SILENT).to_numpy(zero_copy_only=False).astype(np.int8)
    votes = np.array(table.column("votes").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int8).reshape(table.num_rows, len(lexicon.names))
    lists = table.column("words").combine_chunks()
    present = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64) if table.num_rows else np.zeros(1, np.int64)
    with_label = np.column_stack((votes, label))
    model = LabelModel.fit(with_label) if table.num_rows else LabelModel([], [], 0.1)
    targets = model.posterior(with_label)
    starts, features = _features(lexicon, votes, bounds, present)
    return ToxicityModel(lexicon, model, fit_logistic(starts, features, len(lexicon.words) + len(lexicon.names), targets))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text: (id, held_out, score, predicted).

    score, 0 to 1, depends on the text alone. Null and empty texts get the score of a text without any
    known word. Null ids are held out; repeated rows are scored once each; with repeated labels of
    an id the largest counts. Without labels the voters' own model is trained on; without documents
    the result is empty. Other columns are not read. One scan scores, without a shuffle; the model
    is a word list whose length ``FEATURE_WORDS`` bounds.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_toxicity(base, labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")), sample_rows=sample_rows)
    kind = T.StructType([base.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(model.score(part.column("text")))], kind.names)

    scored = base.select("id", (~learned_from(F.col("id"))).alias("held_out"), "text").mapInArrow(score, kind)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches ``threshold``, all columns kept; what holds for ``score_toxicity`` holds here."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_toxicity(base, labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                yield part.filter(pa.array(model.score(part.column(text_col)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
