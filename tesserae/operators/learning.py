"""A projection of tokens into a space of words, learned on Spark from co-occurrence."""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.stages import stage

#: The sharpness of the contrast, and the least length that is divided by.
TEMPERATURE, LEAST = 0.07, 1e-8
#: Different pairs of a shard, about; tokens that a shard draws its negatives from in an epoch; tokens that are compared all with all at most.
SHARD_PAIRS, POOL, SPREAD = 10_000, 4096, 8192


@dataclass
class Settings:
    """The defaults."""

    input_dim: int = 128
    hidden_dim: int = 256
    output_dim: int = 64
    epochs: int = 6
    batch_size: int = 512
    negatives: int = 16
    learning_rate: float = 0.01
    anchor_weight: float = 2.5
    cooccurrence_weight: float = 0.5
    collapse_weight: float = 0.15
    anchor_passes: int = 8
    collapse_sample: int = 512
    seed: int = 7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), LEAST)


@dataclass
class Model:
    """One vector for each token, and a hidden layer with rectifiers that projects it."""

    tokens: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def create(n_tokens: int, s: Settings) -> "Model":
        r = np.random.default_rng(s.seed)
        small = lambda *shape: r.normal(0.0, 0.02, shape)
        return Model(small(n_tokens, s.input_dim), small(s.input_dim, s.hidden_dim), np.zeros(s.hidden_dim), small(s.hidden_dim, s.output_dim), np.zeros(s.output_dim))

    @staticmethod
    def waves(n_tokens: int, s: Settings) -> "Model":
        """A model of fixed weights: sin(3 i + 2 j) / 10 in row i and column j of each table."""
        wave = lambda rows, columns: np.sin(3.0 * np.arange(rows)[:, None] + 2.0 * np.arange(columns)[None, :]) / 10
        return Model(wave(n_tokens, s.input_dim), wave(s.input_dim, s.hidden_dim), np.zeros(s.hidden_dim), wave(s.hidden_dim, s.output_dim), np.zeros(s.output_dim))

    def parts(self) -> dict[str, np.ndarray]:
        return {"tokens": self.tokens, "w1": self.w1, "b1": self.b1[None], "w2": self.w2, "b2": self.b2[None]}

    def copy(self) -> "Model":
        return replace(self, **{k: v.copy() for k, v in vars(self).items()})

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(self.tokens[ids] @ self.w1 + self.b1, 0.0)
        return hidden, hidden @ self.w2 + self.b2

    def back(self, ids: np.ndarray, hidden: np.ndarray, out: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """One step down the slope of a loss in the directions of the projections, whatever their lengths: short vectors take no longer steps."""
        way = unit(out)
        on_out = slope - way * (way * slope).sum(1, keepdims=True)
        on_hidden = np.where(hidden > 0, on_out @ self.w2.T, 0.0)
        on_tokens = on_hidden @ self.w1.T
        self.w1 -= rate * self.tokens[ids].T @ on_hidden
        self.b1 -= rate * on_hidden.sum(0)
        self.w2 -= rate * hidden.T @ on_out
        self.b2 -= rate * on_out.sum(0)
        np.add.at(self.tokens, ids, -rate * on_tokens)


def contrast(v: np.ndarray, near: np.ndarray, far: np.ndarray, share: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """InfoNCE: the loss, and its slope in v, of telling near from far targets. share: how much each row counts, 1 in all."""
    share = np.full(len(v), 1 / max(len(v), 1)) if share is None else share
    logits = np.concatenate([(v * near).sum(1, keepdims=True), np.einsum("nd,nkd->nk", v, far)], 1) / TEMPERATURE
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(np.clip(p[:, 0], LEAST, 1.0)) @ share)
    p[:, 0] -= 1.0
    p *= share[:, None] / TEMPERATURE
    return loss, p[:, :1] * near + np.einsum("nk,nkd->nd", p[:, 1:], far)


def context_step(m: Model, centers: np.ndarray, contexts: np.ndarray, counts: np.ndarray, pool: np.ndarray, s: Settings, r: np.random.Generator) -> float:
    """Both losses of a batch of different pairs, weighted by their counts, with negatives from pool: of the token vectors themselves, then of their projections."""
    others, share = pool[r.integers(0, len(pool), (len(centers), s.negatives))], counts / counts.sum()
    way = unit(m.tokens[centers])
    first, slope = contrast(way, unit(m.tokens[contexts]), unit(m.tokens[others]), share)
    np.add.at(m.tokens, centers, -s.learning_rate * (slope - way * (way * slope).sum(1, keepdims=True)))
    hidden, out = m.forward(centers)
    second, slope = contrast(unit(out), unit(m.forward(contexts)[1]), unit(m.forward(others)[1]), share)
    m.back(centers, hidden, out, s.cooccurrence_weight * slope, s.learning_rate)
    return first + s.cooccurrence_weight * second


def anchor_step(m: Model, ids: np.ndarray, targets: np.ndarray, s: Settings) -> float:
    hidden, out = m.forward(ids)
    cosine = (unit(out) * targets).sum(1)
    m.back(ids, hidden, out, -s.anchor_weight * targets / len(ids), s.learning_rate)
    return s.anchor_weight * float((1 - cosine).mean())


def spread_sample(n_tokens: int, s: Settings, r: np.random.Generator) -> np.ndarray:
    """The tokens of a step against collapse: so many as the settings say, or all."""
    if 0 < s.collapse_sample < n_tokens:
        return r.choice(n_tokens, s.collapse_sample, replace=False)
    if n_tokens > SPREAD:
        raise ValueError(f"collapse_sample asks to compare {n_tokens} tokens with each other; at most {SPREAD}")
    return np.arange(n_tokens)


def spread_step(m: Model, ids: np.ndarray, s: Settings) -> float:
    """Keeps projections from collapsing: raises their variance and lowers their cosines."""
    if not len(ids):
        return 0.0
    hidden, out = m.forward(ids)
    v = unit(out)
    gram = v @ v.T
    m.back(ids, hidden, out, 2 * s.collapse_weight * (gram @ v - (v - v.mean(0))) / len(ids), s.learning_rate)
    off = gram[~np.eye(len(ids), dtype=bool)]
    return s.collapse_weight * float((np.maximum(0, 1 - v.std(0)) ** 2).mean() + (off**2).mean() if len(off) else 0.0)


@dataclass
class Learned:
    """A projection whose token vectors (idx, vector) are a table; layer is a model without tokens, of a size that the settings fix."""

    vectors: DataFrame
    layer: Model

    @staticmethod
    def of(spark: SparkSession, m: Model) -> "Learned":
        rows = list(enumerate(m.tokens.tolist()))
        return Learned(spark.createDataFrame(rows, "idx int, vector array<double>"), replace(m, tokens=m.tokens[:0]))

    @staticmethod
    def waves(vocab: DataFrame, s: Settings) -> "Learned":
        """Fixed weights, as Model.waves() has them."""
        place = F.sequence(F.lit(0), F.lit(s.input_dim - 1))
        return Learned(vocab.select("idx", F.transform(place, lambda j: F.sin(3.0 * F.col("idx") + 2.0 * j) / 10).alias("vector")), Model.waves(0, s))

    def some(self, ids: np.ndarray) -> Model:
        """A model of these tokens alone, in their order."""
        found = {r.idx: r.vector for r in self.vectors.where(F.col("idx").isin([int(i) for i in ids])).collect()}
        return replace(self.layer.copy(), tokens=np.array([found[int(i)] for i in ids], float).reshape(len(ids), len(self.layer.w1)))

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.some(ids).forward(np.arange(len(ids)))


def first_vectors(spark: SparkSession, n_tokens: int, s: Settings) -> DataFrame:
    """idx and vector: normal numbers with deviation 0.02 that depend on the seed, the token and the place only."""
    even = lambda k, j: (F.pmod(F.xxhash64(F.lit(s.seed), F.lit(k), F.col("idx"), j), F.lit(1 << 31)) + 0.5) / (1 << 31)
    normal = lambda j: 0.02 * F.sqrt(-2.0 * F.log(even(0, j))) * F.cos(2 * np.pi * even(1, j))
    ids = spark.range(n_tokens).select(F.col("id").cast("int").alias("idx"))
    return ids.select("idx", F.transform(F.sequence(F.lit(0), F.lit(s.input_dim - 1)), normal).alias("vector"))


def shard_vectors(pairs: DataFrame, vectors: DataFrame, n_tokens: int, shards: int, epoch: int) -> DataFrame:
    """shard, idx, far and vector of each token that a shard's pairs name, and (far) of those it draws negatives from: all of a small vocabulary, else POOL draws."""
    own = pairs.select("shard", F.explode(F.array("center_idx", "context_idx")).alias("idx"), F.lit(False).alias("far"))
    drawn = F.col("k") if n_tokens <= POOL else F.pmod(F.xxhash64(F.lit(epoch), "shard", "k"), F.lit(n_tokens))
    each = own.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(min(n_tokens, POOL) - 1))).alias("k"))
    far = each.select("shard", drawn.cast("int").alias("idx"), F.lit(True).alias("far"))
    return far.unionByName(own).groupBy("shard", "idx").agg(F.max("far").alias("far")).join(vectors, "idx")


def fit_projection(counts: DataFrame, n_tokens: int, settings: Settings, anchors: tuple[np.ndarray, np.ndarray] | None = None, shards: int | None = None) -> tuple[Learned, list[float]]:
    """The projection and the loss of each epoch, learned from center_idx, context_idx and n.

    In an epoch each shard of the pairs (by default one for SHARD_PAIRS) meets the vectors of the tokens that it names and of a pool of
    negatives, and takes its own steps from the common model, batch by batch and in an order of its own; the shards' changes are averaged
    row by row on Spark, weighted by their pairs, and give the next table of vectors. A pair with count n counts n
    times in its batch. Then come the steps of the anchors (ids and unit targets) and the one against collapse, on the driver: with the layer,
    they are all that passes it, and their number of rows doesn't grow with the tokens. Without pairs the losses are 0.
    """
    spark = counts.sparkSession
    pairs = stage(counts.select(F.col("center_idx").cast("int").alias("center_idx"), F.col("context_idx").cast("int").alias("context_idx"), F.col("n").cast("long").alias("n")), "counts")
    shards = shards or max(1, -(-pairs.count() // SHARD_PAIRS))
    pairs = stage(pairs.withColumn("shard", F.pmod(F.xxhash64("center_idx", "context_idx"), F.lit(shards)).cast("int")), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    m, losses = Learned(stage(first_vectors(spark, n_tokens, settings), "vectors"), Model.create(0, settings)), []
    for epoch in range(settings.epochs):
        held = spark.sparkContext.broadcast((m.layer, settings, epoch))

        def learn(key: tuple, named: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            layer, s, at = held.value
            columns = ["part", "row", "change"]
            if not len(named):
                return pd.DataFrame([], columns=columns)
            named, known = named.sort_values(["center_idx", "context_idx", "n"]), known.sort_values("idx")
            ids, pool = known["idx"].to_numpy(), np.flatnonzero(known["far"].to_numpy())
            start, r = replace(layer, tokens=np.stack(known["vector"].to_numpy())), np.random.default_rng([s.seed, at, int(key[0])])
            own, order = start.copy(), r.permutation(len(named))
            c, x = (np.searchsorted(ids, named[k].to_numpy()[order]) for k in ("center_idx", "context_idx"))
            n = named["n"].to_numpy()[order]
            batches = (slice(k, k + s.batch_size) for k in range(0, len(c), s.batch_size))
            lost = sum(int(n[b].sum()) * context_step(own, c[b], x[b], n[b], pool, s, r) for b in batches)
            taken, out = int(n.sum()), [("loss", 0, [lost])]
            for name, after in own.parts().items():
                change = (after - start.parts()[name]) * taken
                out += [(name, int(ids[i]) if name == "tokens" else int(i), change[i].tolist()) for i in np.flatnonzero(np.abs(change).max(1) > 0)]
            return pd.DataFrame(out, columns=columns)

        loss = 0.0
        if total:
            known = shard_vectors(pairs, m.vectors, n_tokens, shards, epoch)
            changes = pairs.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(learn, "part string, row long, change array<double>")
            sums = stage(changes.groupBy("part", "row").agg(vector_to_array(Summarizer.sum(array_to_vector("change"))).alias("change")), "changes")
            layer = m.layer.copy()
            for x in sums.where("part <> 'tokens'").collect():  # the rows of the layer
                if x.part == "loss":
                    loss = x.change[0] / total
                else:
                    layer.parts()[x.part][x.row] += np.array(x.change) / total
            moved = sums.where("part = 'tokens'").select(F.col("row").cast("int").alias("idx"), "change")
            vector = F.when(F.col("change").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "change", lambda v, c: v + c / total))
            m = Learned(stage(m.vectors.join(moved, "idx", "left").select("idx", vector.alias("vector")), "vectors"), layer)
        sample = spread_sample(n_tokens, settings, np.random.default_rng([settings.seed, epoch, 1 << 20]))
        drawn = anchors[0] if anchors is not None else np.zeros(0, np.int64)
        ids = np.union1d(sample, drawn).astype(np.int64)
        some = m.some(ids)
        for _ in range(settings.anchor_passes if len(drawn) else 0):
            anchor_step(some, np.searchsorted(ids, drawn), anchors[1], settings)
        spread_step(some, np.searchsorted(ids, sample), settings)
        touched = spark.createDataFrame(list(zip(ids.tolist(), some.tokens.tolist())), "idx int, after array<double>")
        after = m.vectors.join(F.broadcast(touched), "idx", "left").select("idx", F.coalesce("after", "vector").alias("vector"))
        m = Learned(stage(after, "vectors"), replace(some, tokens=some.tokens[:0]))
        losses.append(loss)
    return m, losses


def project(vocab: DataFrame, m: Learned | Model) -> DataFrame:
    """token, idx and projected of every token of the vocabulary, in batches with the layer broadcast; null where the model has no vector."""
    spark = vocab.sparkSession
    m = Learned.of(spark, m) if isinstance(m, Model) else m
    held = spark.sparkContext.broadcast(m.layer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = part["vector"].notna().to_numpy()
            own = replace(held.value, tokens=np.stack(part["vector"][there]) if there.any() else held.value.tokens)
            found = iter(own.forward(np.arange(there.sum()))[1])
            yield part[["token", "idx"]].assign(projected=[next(found) if t else None for t in there])

    return vocab.select("token", "idx").join(m.vectors, "idx", "left").mapInPandas(run, "token string, idx int, projected array<double>")


def principal_plane(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x and y: the centred vectors on their first two principal axes; the greatest coordinate of an axis is positive."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = stage(vectors.where(f"{vector} IS NOT NULL").select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v")), "pca")
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    p = vector_to_array("p")
    return model.transform(centred).select(key, (p[0] * float(sign[0])).alias("x"), (p[1] * float(sign[1])).alias("y"))
