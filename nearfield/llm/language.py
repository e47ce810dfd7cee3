"""Language identification by hierarchical discrimination.

A text becomes its square-rooted shares of hashed byte 2- to 4-grams. One-versus-one linear
support vector machines choose the language family, and those of that family's languages
choose between them. The machines are trained on the driver by dual coordinate descent
from at most ``PER_LANGUAGE`` labelled documents of each language (those of least hash),
whose features the executors compute.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text if
nothing was learned; with a single language learned the score is 1; repeated rows count each;
rows with null text or language are not learned from; columns not named are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most labelled documents of a language that are learned from, and of all together.
PER_LANGUAGE, IN_ALL = 250, 8_000
FEATURES = 1 << 12
#: So many times the documents needed of a language are expected in the range of hashes that is looked at.
AMPLE = 8
#: Bytes of a text whose grams are counted at a time.
STEP = 1 << 20
#: How fast confidence grows with the margin.
SLOPE = 4.0
UNKNOWN = "und"

# Families of common languages by ISO 639-1 code; any other is its own family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "finnic": "et fi",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tk tt uz",
    "austronesian": "id jv mg mi ms tl",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte grams; the vector's length is 1."""
    data = b" " + text.encode("utf-8", "replace").translate(_PLAIN) + b" "
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(data), STEP):
        b = np.frombuffer(data[at : at + STEP + 3], dtype=np.uint8).astype(np.uint32)
        last = at + STEP >= len(data)
        code = b
        for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
            code = (code[:-1] * np.uint32(factor)) ^ b[size - 1 :]
            use = code if last else code[:STEP]  # the rest is counted with the next step
            counts += np.bincount(((use * np.uint32(0x27D4EB2F)) >> np.uint32(20)).astype(np.int64), minlength=FEATURES)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def svm(x: np.ndarray, use: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear machine (squared hinge) for the rows ``use`` of ``x``, by dual coordinate descent."""
    weights, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(use))
    diagonal = [float(x[row] @ x[row]) + 1 + 0.5 / cost for row in use]
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(use)).tolist():
            own = x[use[i]]
            step = max(alpha[i] - (y[i] * (float(weights @ own) + bias) - 1 + 0.5 * alpha[i] / cost) / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights += (step * y[i]) * own
                bias += step * y[i]
    return np.append(weights, bias).astype(np.float32)


@dataclass
class Choice:
    """One-versus-one machines over some names: most wins, then the larger sum of margins."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        wins, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(self.pairs, margins):
            wins[a if m > 0 else b] += 1
            sums[[a, b]] += (m, -m)
            least[[a, b]] = np.minimum(least[[a, b]], (m, -m))
        best = max(range(len(self.names)), key=lambda i: (wins[i], sums[i]))
        return self.names[best], float(1 / (1 + np.exp(-SLOPE * least[best])))

    @staticmethod
    def learn(x: np.ndarray, labels: np.ndarray, among: np.ndarray) -> Choice:
        """Machines over the labels of the rows ``among``."""
        names = sorted(set(labels[among]))
        pairs = list(combinations(range(len(names)), 2))
        weights = []
        for a, b in pairs:
            use = among[(labels[among] == names[a]) | (labels[among] == names[b])]
            weights.append(svm(x, use, np.where(labels[use] == names[a], 1.0, -1.0)))
        return Choice(names, pairs, np.stack(weights) if weights else None)


@dataclass
class LanguageModel:
    family: Choice | None
    within: dict[str, Choice]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if self.family is None or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.family(x)
        language, surer = self.within[family](x)
        return language, sure * surer


def _feature_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())


def _sample(rows: DataFrame, shares: dict[str, float]) -> pa.Table:
    """Language, place and features of each language's first documents by hash, from a share of its hashes."""
    least = F.lit(-(2**63))
    for share in sorted(set(shares.values())):
        codes = [code for code, own in shares.items() if own == share]
        least = F.when(F.col("lang").isin(codes), F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).otherwise(least)
    first = Window.partitionBy("lang").orderBy("order", "key", "text")
    rows = rows.filter(F.col("order") <= least).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PER_LANGUAGE)
    return rows.select("lang", "n", F.arrow_udf(_feature_bytes, "binary")("text").alias("x")).orderBy("n", "lang").limit(IN_ALL).toArrow()


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from the labelled rows' text and language (the key only orders the sample)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("order"), F.col(key).alias("key")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(IN_ALL).collect()}
    # hashes are uniform: this share of a language surely holds its documents of least hash
    shares = {code: min(1.0, AMPLE * PER_LANGUAGE / n) for code, n in sizes.items()}
    found = _sample(rows, shares)
    taken = Counter(found["lang"].to_pylist())
    if any(share < 1 and taken[code] < PER_LANGUAGE for code, share in shares.items()):  # ids that repeat
        found = _sample(rows, dict.fromkeys(shares, 1.0))
    if not len(found):
        return LanguageModel(None, {})
    x = np.frombuffer(found["x"].combine_chunks().buffers()[2], dtype=np.float32, count=len(found) * FEATURES).reshape(-1, FEATURES)  # 131 MB at most
    labels = np.array(found["lang"].to_pylist(), dtype=object)
    families = np.array([FAMILY_OF.get(code, code) for code in labels], dtype=object)
    return LanguageModel(Choice.learn(x, families, np.arange(len(x))), {f: Choice.learn(x, labels, np.flatnonzero(families == f)) for f in sorted(set(families))})


def predict(documents: DataFrame, model: LanguageModel, text: str = "text", to: str = "language") -> DataFrame:
    """``documents`` with a struct of lang and score in the column ``to``."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang", "score"), model(t.as_py()))) for t in texts], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return documents.withColumn(to, F.arrow_udf(run, "struct<lang:string,score:double>")(F.col(text)))
