"""Maximum-inner-product search: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import table
from repseq.session import cut_lineage

#: Rows that the codebooks are fitted on (those with the smallest seeded hash). Every row is encoded and searched.
SAMPLE = 20_000
#: Components in a subspace, codes in a codebook (four bits), and the score share from which a neighbour matters.
WIDTH, CODES, THRESHOLD = 2, 16, 0.2
#: Candidates of a block that are scored exactly, per neighbour asked for.
RERANK = 20
#: Rows of the table in a block, and queries in one. Each row is sent once for a block of queries and each query once for a
#: block of rows, so larger blocks send less; a block of 64 components takes some 50 MB in a worker.
ROWS, QUERIES = 32_768, 65_536


class Codebooks:
    """Product quantisation whose loss weighs the residual's part along the vector ``eta`` times the part across it."""

    def __init__(self, dim: int, width: int = WIDTH, codes: int = CODES, threshold: float = THRESHOLD):
        self.dim, self.width = dim, width
        self.parts = -(-dim // width)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.centres = np.zeros((self.parts, codes, width))

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = self.parts * self.width - self.dim
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.parts, self.width)

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 0) -> Codebooks:
        rng, s = np.random.default_rng(seed), self._split(x)
        codes = self.centres.shape[1]
        for p in range(self.parts):  # plain k-means to start from
            c = s[rng.choice(len(s), codes, replace=len(s) < codes), p].copy()
            for _ in range(5):
                near = ((s[:, p, None] - c) ** 2).sum(2).argmin(1)
                for k in range(codes):
                    if (near == k).any():
                        c[k] = s[near == k, p].mean(0)
            self.centres[p] = c
        unit = s / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        for _ in range(rounds):
            code = self.encode(x, sweeps=1)
            along = self._along(s, unit, code)
            for p in range(self.parts):  # least squares for each centre, the other subspaces held
                u, now = unit[:, p], (s[:, p] - self.centres[p, code[:, p]])
                rest = along - (now * u).sum(1) + (s[:, p] * u).sum(1)
                for k in range(codes):
                    m = code[:, p] == k
                    if m.any():
                        a = m.sum() * np.eye(self.width) + (self.eta - 1) * u[m].T @ u[m]
                        self.centres[p, k] = np.linalg.solve(a, s[m, p].sum(0) + (self.eta - 1) * (rest[m, None] * u[m]).sum(0))
                along = rest - (self.centres[p, code[:, p]] * u).sum(1)
        return self

    def _along(self, s, unit, code) -> np.ndarray:
        picked = self.centres[np.arange(self.parts), code]
        return ((s - picked) * unit).sum((1, 2))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by subspace: nearest centres first, then coordinate descent on the anisotropic loss."""
        out = np.empty((len(x), self.parts), np.uint8)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            s = self._split(part)
            unit = s / np.maximum(np.linalg.norm(part, axis=1), 1e-30)[:, None, None]
            off = s[:, :, None, :] - self.centres  # rows, subspaces, codes, width
            square, proj = (off**2).sum(3), (off * unit[:, :, None, :]).sum(3)
            code = square.argmin(2)
            rows = np.arange(len(part))
            along = np.take_along_axis(proj, code[:, :, None], 2)[:, :, 0].sum(1)
            for _ in range(sweeps):
                for p in range(self.parts):
                    rest = along - proj[rows, p, code[:, p]]
                    code[:, p] = (square[:, p] + (self.eta - 1) * (rest[:, None] + proj[:, p]) ** 2).argmin(1)
                    along = rest + proj[rows, p, code[:, p]]
            out[start : start + 4096] = code
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's subspaces with all centres: queries, subspaces, codes."""
        return np.einsum("qpw,pkw->qpk", self._split(q), self.centres)

    def scan(self, q: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries by rows, by table lookups; two four-bit codes share a lookup."""
        t = self.tables(q).astype(np.float32)
        if self.parts % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], 1)
            code = np.concatenate([code, np.zeros_like(code[:, :1])], 1)
        pair = (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), t.shape[1] // 2, -1)
        both = code[:, 0::2].astype(np.int64) * self.centres.shape[1] + code[:, 1::2]
        out = np.zeros((len(q), len(code)), np.float32)
        for p in range(pair.shape[1]):
            out += pair[:, p].take(both[:, p], axis=1)
        return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part: a key, and a vector of finite components that are not all 0."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _search(left: pd.DataFrame, right: pd.DataFrame, books: Codebooks, k: int, rerank: int) -> pd.DataFrame:
    """The ``k`` best rows of one block for each query of one block."""
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    right = right.sort_values("id", kind="stable")
    ids, x = right["id"].to_numpy(), np.stack(right["v"].to_numpy())
    code = np.stack(right["code"].map(lambda b: np.frombuffer(b, np.uint8)).to_numpy())
    queries, q = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
    out, want = [], min(len(ids), k * rerank + 1)
    for start in range(0, len(q), 64):
        near = books.scan(q[start : start + 64], code)
        edge = np.partition(near, len(ids) - want, axis=1)[:, len(ids) - want]
        for i, row in enumerate(near):
            at = np.flatnonzero(row >= edge[i])  # all that tie with the last: none is dropped by chance
            me = queries[start + i]
            at = at[ids[at] != me]
            exact = (x[at] * q[start + i]).sum(1)
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best), me), ids[at][best], exact[best]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def search(
    df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, rows: int = ROWS, block: int = QUERIES
) -> DataFrame:
    """The ``k`` rows of ``df`` with the largest inner product for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Scores are exact, in double precision, on the original vectors; ties go to the smaller key, and a query is not its
    own neighbour. Queries with equal keys are one (the smallest vector). Rows and queries without a key, or with a vector that is NULL, all zero or not finite take no part,
    nor do vectors of another length than most. Fewer rows than ``k`` give them all; an empty table gives none.

    The table is cut into blocks by a hash of the key, each met once by each block of queries: a task scans its block's
    four-bit codes with the query's tables and scores the ``k * rerank`` best (and all that tie with the last of them)
    exactly; the blocks' results are merged. No task holds more than one block of each; hot vectors spread by their keys.
    """
    spark = df.sparkSession
    base = cut_lineage(usable(df, key, vector).withColumn("h", F.xxhash64(F.lit(3), "id")).select("id", "v", "h"))
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.where(F.size("v") == sizes.dim)
    asked = usable(queries, key, vector).where(F.size("v") == sizes.dim).groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries = sizes["count"], asked.count()
    first = base.orderBy("h").limit(sample).select("v").toPandas()["v"]
    books = Codebooks(sizes.dim).fit(np.stack(first.to_numpy()))
    shared = spark.sparkContext.broadcast(books)
    blocks, groups = math.ceil(n / rows), max(1, math.ceil(n_queries / block))

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in shared.value.encode(np.stack(v.to_numpy()))]) if len(v) else pd.Series([], dtype=object)

    def spread(d: DataFrame, own: str, mine: int, other: str, many: int) -> DataFrame:
        d = d.withColumn(own, F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(mine)).cast("int"))
        return d.withColumn(other, F.explode(F.expr(f"sequence(0, {many - 1})")))

    right = spread(base.select("id", "v", encode("v").alias("code")), "rb", blocks, "qb", groups)
    left = spread(asked, "qb", groups, "rb", blocks)
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(lambda a, b: _search(a, b, shared.value, k, rerank), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
