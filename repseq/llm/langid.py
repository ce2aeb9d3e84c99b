"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum, over all ways to cut it into vocabulary pieces, of the product of the
pieces' probabilities; the forward algorithm sums them. Piece probabilities are fitted by expectation-maximisation over
the same lattice (so no segmentation is ever chosen). A text's log-likelihood is the sum over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import dealt, fold, rows, spare, table
from repseq.session import cut_lineage, give_back, given_back, small_batches, tasks

#: Words: runs of letters with their marks. Digits and other numerals are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PIECE = regex.compile(r"[\p{L}\p{M}]+")
MARK = "▁"
#: Probability of a character that no piece covers, the same in every language.
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Training documents per language: the classifier is fitted on a bounded sample of the labelled rows.
SAMPLE = 400
#: A text is foreign to a language if a letter costs so many times what it costs in that language's training texts.
FOREIGN = 2.5
#: Words up to so many letters are summed many at once; longer ones one by one, in blocks, with the same result.
SHORT = 32
_CHUNK, _FLOATS, _BLOCK = 2_000_000, 2_000_000, 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that consist of lower-case letters, with or without the word mark."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if p == MARK or (_PIECE.fullmatch(p.removeprefix(MARK)) and p == p.lower())})


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """The lattice over a vocabulary file, built once in a process."""
    return Lattice(letter_pieces(path))


class Lattice:
    """Sums over all segmentations of many words at once."""

    _BASE, _MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.keys = np.array([self._hash(p) for p in pieces] + [0], np.uint64)
        if len(set(self.keys.tolist())) < len(self.keys):
            raise ValueError("piece hashes collide")
        self.slots = np.full((1 << self._BITS) + 64, len(pieces), np.int32)
        for i, k in enumerate(self.keys[:-1]):
            s = self._slot(k)
            while self.slots[s] != len(pieces):
                s += 1
            self.slots[s] = i

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return (h * self._MIX) >> np.uint64(64 - self._BITS)

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * self._BASE + np.uint64(ord(c) + 1)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``len(pieces)`` where there is none."""
        none, slot = len(self.pieces), self._slot(h).astype(np.int64)
        found = self.slots[slot]
        wrong = np.flatnonzero((found != none) & (self.keys[found] != h))
        while len(wrong):
            slot[wrong] += 1
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] != none) & (self.keys[found[wrong]] != h[wrong])]
        return found

    # Many short words -----------------------------------------------------------------------------------------------
    def steps(self, words: list[str]):
        """Words sorted by length (longest first), and for each span ``(i, j)`` the rows and pieces that cover it."""
        marked = [MARK + w for w in words]
        size = np.array([len(w) for w in marked])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0])
        codes = np.array([marked[i] for i in order], dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
        spans = []
        with np.errstate(over="ignore"):
            for i in range(width):
                h = np.zeros(len(words), np.uint64)
                for j in range(i + 1, min(width, i + self.longest) + 1):
                    live = int(np.searchsorted(-size, -j, side="right"))
                    if not live:
                        break
                    h = h[:live] * self._BASE + (codes[:live, j - 1] + np.uint64(1))
                    piece = self._find(h)
                    at = np.flatnonzero(piece != len(self.pieces))
                    if j == i + 1 and len(at) < live:
                        spans.append((i, j, np.flatnonzero(piece == len(self.pieces)), None))
                    if len(at):
                        spans.append((i, j, at, piece[at]))
        return order, size, spans

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language; ``prob`` is pieces by languages."""
        out = np.empty((len(words), prob.shape[1]))
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        step = self._many(prob)
        for a in range(0, len(short), step):
            part = short[a : a + step]
            order, size, spans = self.steps([words[i] for i in part])
            out[np.array(part)[order]] = np.log(self._alpha(size, spans, prob)[np.arange(len(size)), size])
        padded = np.vstack([prob, np.zeros((1, prob.shape[1]))])
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._one(w, padded)
        return out

    def _many(self, prob: np.ndarray) -> int:
        """How many short words are summed at once."""
        return max(64, _FLOATS // ((SHORT + 2) * prob.shape[1]))

    def _alpha(self, size, spans, prob):
        alpha = np.zeros((len(size), int(size[0]) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for i, j, at, piece in spans:
            alpha[at, j] += alpha[at, i] * (UNKNOWN if piece is None else prob[piece])
        return alpha

    def expect(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts by language, of words with ``counts`` (words by languages)."""
        out = np.zeros_like(prob)
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        step = self._many(prob)
        for a in range(0, len(short), step):
            part = np.array(short[a : a + step])
            order, size, spans = self.steps([words[i] for i in part])
            alpha = self._alpha(size, spans, prob)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(size)), size] = 1
            for i, j, at, piece in reversed(spans):
                beta[at, i] += beta[at, j] * (UNKNOWN if piece is None else prob[piece])
            weight = counts[part[order]] / alpha[np.arange(len(size)), size]
            for i, j, at, piece in spans:
                if piece is not None:
                    each = alpha[at, i] * prob[piece] * beta[at, j] * weight[at]
                    for k in range(prob.shape[1]):
                        out[:, k] += np.bincount(piece, each[:, k], len(prob))
        padded = np.vstack([prob, np.zeros((1, prob.shape[1]))])
        for i, w in enumerate(words):
            if len(w) > SHORT:
                self._expect_one(w, counts[i], padded, out)
        return out

    # One long word --------------------------------------------------------------------------------------------------
    def _codes(self, word: str) -> np.ndarray:
        return np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def _ending(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """Pieces that end at positions ``a + 1`` to ``b``: positions by lengths."""
        low = max(0, a - self.longest + 1)
        part, power = codes[low:b], np.uint64(1)
        h, found = np.zeros(len(part), np.uint64), np.full((len(part), self.longest), len(self.pieces), np.int32)
        with np.errstate(over="ignore"):
            for d in range(min(self.longest, len(part))):
                h[d:] += part[: len(part) - d] * power
                found[d:, d] = self._find(h[d:])
                power *= self._BASE
        return found[a - low :]

    def _chances(self, ids: np.ndarray, padded: np.ndarray) -> np.ndarray:
        """Probabilities of those pieces; a lone character that is no piece has ``UNKNOWN``."""
        p = padded[ids]
        p[ids[:, 0] == len(self.pieces), 0] = UNKNOWN
        return p

    def _run(self, n: int, chances: Callable[[int, int], np.ndarray], languages: int, keep: bool):
        """The sums at positions 0 to ``n`` with the logarithms of their scales (only the last ones unless ``keep``).

        ``chances(a, b)`` gives, for positions ``a + 1`` to ``b``, the weights of the steps that end there, by length.
        Sums are scaled anew every few positions, so no word is too long for them; the window holds ``longest`` of them.
        """
        window, scale = np.zeros((self.longest, languages)), np.zeros(languages)
        window[-1] = 1
        values = [window[-1:].copy()] if keep else []
        scales = [scale[None].copy()] if keep else []
        step = max(_BLOCK, _FLOATS // (self.longest * languages) // _BLOCK * _BLOCK)
        for a in range(0, n, step):
            part = chances(a, min(n, a + step))[:, ::-1]
            for c in range(0, len(part), _BLOCK):
                block = part[c : c + _BLOCK]
                buffer = np.concatenate([window, np.zeros((len(block), languages))])
                for t in range(len(block)):
                    buffer[self.longest + t] = (block[t] * buffer[t : t + self.longest]).sum(0)
                if keep:
                    values.append(buffer[self.longest :].copy())
                    scales.append(np.repeat(scale[None], len(block), 0))
                window = buffer[-self.longest :]
                top = window.max(0)
                window, scale = window / top, scale + np.log(top)
        if keep:
            return np.concatenate(values), np.concatenate(scales)
        return window[-1], scale

    def _one(self, word: str, padded: np.ndarray) -> np.ndarray:
        codes = self._codes(word)
        last, scale = self._run(len(codes), lambda a, b: self._chances(self._ending(codes, a, b), padded), padded.shape[1], False)
        return np.log(last) + scale

    def _expect_one(self, word: str, count: np.ndarray, padded: np.ndarray, out: np.ndarray) -> None:
        codes = self._codes(word)
        n, many = len(codes), padded.shape[1]

        def forwards(a, b):
            return self._chances(self._ending(codes, a, b), padded)

        def backwards(a, b):
            """The same steps by where they start, from the word's end on."""
            low, high = n - b, n - a
            p = forwards(low, min(n, high + self.longest - 1))
            turned = np.zeros((high - low, self.longest, many))
            for d in range(self.longest):
                have = p[d : d + high - low, d]
                turned[: len(have), d] = have
            return turned[::-1]

        alpha, up = self._run(n, forwards, many, True)
        beta, down = (x[::-1] for x in self._run(n, backwards, many, True))
        whole = np.log(alpha[n]) + up[n]
        step = max(1, _FLOATS // (self.longest * many))
        for a in range(0, n, step):
            b = min(n, a + step)
            ids = self._ending(codes, a, b)
            for d in range(self.longest):
                ends = np.flatnonzero(ids[:, d] != len(self.pieces))
                e, piece = ends + a + 1, ids[ends, d]
                s = e - d - 1
                each = alpha[s] * padded[piece] * beta[e] * np.exp(up[s] + down[e] - whole) * count
                for k in range(many):
                    out[:, k] += np.bincount(piece, each[:, k], len(out))

    def settle(self, expected: np.ndarray, add: float = 0.02) -> np.ndarray:
        """Piece probabilities from expected counts."""
        return (expected + add) / (expected.sum(0) + add * len(expected))

    def even(self, languages: int) -> np.ndarray:
        return np.full((len(self.pieces), languages), 1 / len(self.pieces))


class Model:
    """Languages, their piece probabilities over the vocabulary, and the least log-likelihood a letter that is usual."""

    def __init__(self, path: str, languages: list[str], prob: np.ndarray, floor: np.ndarray | None = None, cache: int = 200_000):
        self.path, self.languages, self.prob, self.cache = path, languages, prob, cache
        self.floor = np.full(len(languages), -np.inf) if floor is None else floor
        self._ready = False

    def __getstate__(self):
        return self.path, self.languages, self.prob, self.floor, self.cache

    def __setstate__(self, state):
        self.path, self.languages, self.prob, self.floor, self.cache = state
        self._ready = False

    def _start(self):
        if not self._ready:
            self.seen, self.table, self._ready = {}, np.empty((0, len(self.languages) + 1)), True

    def _learn(self, words: set[str]) -> None:
        """Scores the short words that the cache lacks; the cache is emptied first if it would grow beyond its bound."""
        new = [w for w in words if w not in self.seen and len(w) <= SHORT]
        if new and len(self.seen) + len(new) > self.cache:
            self.seen, self.table, new = {}, np.empty((0, len(self.languages) + 1)), [w for w in words if len(w) <= SHORT]
        if new:
            self.table = np.concatenate([self.table, self._rows(new)])
            self.seen |= {w: len(self.seen) + i for i, w in enumerate(new)}

    def _rows(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words, with their lengths as the last column."""
        return np.column_stack([lattice(self.path).forward(words, self.prob), [len(w) for w in words]])

    def likelihoods(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Log-likelihoods of each text in the languages, and its number of letters."""
        self._start()
        words = [LETTERS.findall(t.lower()) for t in texts]
        self._learn(set().union(*words))
        for w in words:
            at = list(map(self.seen.get, w))
            if None in at:
                far = self._rows([x for x, i in zip(w, at, strict=True) if i is None]).sum(0)
                at = [i for i in at if i is not None]
            else:
                far = 0.0
            whole = self.table[np.array(at, np.int64)].sum(0) + far
            yield whole[:-1], int(whole[-1])

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, its posterior (equal priors), and how far the log-likelihood a letter lies above the usual least.

        ``und``, 0 and 0 for a text without letters.
        """
        if not self.languages:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        out = []
        for ll, letters in self.likelihoods(texts):
            if not letters:
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            best = int(ll.argmax())
            out.append((self.languages[best], float(1 / np.exp(ll - ll[best]).sum()), float(ll[best] / letters - self.floor[best])))
        return out


def sample_rows(df: DataFrame, by: str, hashed: str, size: int) -> DataFrame:
    """Up to ``size`` rows of each ``by`` value: distinct ``hashed`` values, the smallest ones.

    Rows are counted by value first, and only the share of them that holds four times ``size`` on average is ranked; so no
    task meets all rows of a value, and equal rows count once.
    """
    many = {r[0]: r["count"] for r in df.groupBy(by).count().collect()}
    if not many:
        return df.limit(0)
    share = F.create_map(*(F.lit(x) for v, n in many.items() for x in (v, min(1.0, 4 * size / n))))
    low = df.where(F.shiftrightunsigned(hashed, 11) / float(1 << 53) < share[F.col(by)]).dropDuplicates([by, hashed])
    (rank,) = spare(df, "_rank")
    return low.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(hashed))).where(F.col(rank) <= size).drop(rank)


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", path: str | None = None, sample: int = SAMPLE, rounds: int = 5) -> Model:
    """Fits a model on up to ``sample`` rows of each language (those with the smallest seeded hash of key and text).

    Rows with a NULL text or language teach nothing. Without any labelled row, or any letter in them, the model knows no
    language and calls every text ``und``. Words are counted and their expected piece counts summed on the executors; only
    the piece probabilities (vocabulary by languages) come to the driver. Words of any length are summed whole.
    """
    path, spark = path or default_path(), df.sparkSession
    df = df.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.lit(7), F.col(key), F.col(text)).alias("h")).where("t IS NOT NULL AND l IS NOT NULL")
    chosen = cut_lineage(sample_rows(df, "l", "h", sample).select("t", "l").repartition(tasks(spark)))

    def count(batches):
        for b in batches:
            for t, language in rows(b, "t", "l"):
                n = Counter(LETTERS.findall(t.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(n)), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["l", "w", "n"])

    total = chosen.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    words = cut_lineage(total.groupBy("w").agg(F.collect_list(F.struct("l", "n")).alias("c")).repartition(tasks(spark), "w"))
    languages = sorted(r.l for r in words.select(F.explode("c.l").alias("l")).distinct().collect())
    if not languages:
        return Model(path, [], np.empty((0, 0)))
    column = {x: i for i, x in enumerate(languages)}

    def expected(prob):
        shared = spark.sparkContext.broadcast(prob)

        def step(batches):
            out, sums = lattice(path), np.zeros_like(shared.value)
            for b in batches:
                counts = np.zeros((b.num_rows, len(languages)))
                for i, c in enumerate(b.column("c").to_pylist()):
                    for x in c:
                        counts[i, column[x["l"]]] = x["n"]
                sums += out.expect(b.column("w").to_pylist(), counts, shared.value)
            p, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[p, k])], ["p", "k", "x"])

        found = words.mapInArrow(lambda it: given_back(step(it)), "p int, k int, x double").groupBy("p", "k").agg(F.sum("x").alias("x")).toArrow()
        shared.destroy()
        sums = np.zeros_like(prob)
        sums[found["p"].to_numpy(), found["k"].to_numpy()] = found["x"].to_numpy()
        return sums

    own = lattice(path)
    prob = own.even(len(languages))
    for _ in range(rounds):
        prob = own.settle(expected(prob))
    shared = spark.sparkContext.broadcast(Model(path, languages, prob))

    def rate(batches):
        for b in batches:
            for part in _chunks(rows(b, "t", "l"), lambda r: len(r[0])):
                for (ll, letters), (_, language) in zip(shared.value.likelihoods([t for t, _ in part]), part, strict=True):
                    if letters:
                        yield pa.RecordBatch.from_arrays([pa.array([column[language]], pa.int32()), pa.array([ll[column[language]] / letters])], ["k", "x"])

    usual = chosen.mapInArrow(rate, "k int, x double").groupBy("k").agg(F.avg("x").alias("m")).collect()
    floor = np.full(len(languages), -np.inf)
    for r in usual:
        floor[r.k] = FOREIGN * r.m
    return Model(path, languages, prob, floor)


def _chunks(values: Iterable, size: Callable[[object], int]):
    """Lists of values of bounded total size."""
    part, total = [], 0
    for v in values:
        part.append(v)
        total += size(v)
        if total > _CHUNK:
            yield part
            part, total = [], 0
    if part:
        yield part


def identify(df: DataFrame, model: Model, *, text: str = "text", out: str = "language") -> DataFrame:
    """Adds the struct column ``out`` to every row: ``lang``, ``score`` (its posterior, 0 to 1), and ``fit``: how far the
    log-likelihood a letter lies above what is least usual for that language. Only the text is looked at.

    NULL texts and texts without a letter get ``und`` and 0. Rows are not moved. A column named like ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double, fit: double>")
    def predict(texts):
        import pandas as pd

        whole = ("" if t is None else t for t in texts)
        found = [x for part in _chunks(whole, len) for x in shared.value.predict(part)]
        give_back()
        return pd.DataFrame(found, columns=["lang", "score", "fit"])

    return df.drop(out).withColumn(out, predict(F.col(text)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model that learns from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1))
    found = identify(dealt(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.fit").alias("fit"))


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is found with a posterior of ``least`` or more, and whose letters are about
    as likely in it as those of its training documents, stay, each repeated row as often as it comes.

    NULL and empty texts and those without letters go; a NULL in another column changes nothing; no rows give no rows;
    where no document has a language, none can be found and all go. Columns stay as they are, whatever their names.
    """
    small_batches(spark)
    (name,) = spare(docs, "language")
    found = identify(docs, train(docs.where(fold("doc_id", 3) != 1)), out=name)
    language = F.col(name)
    return found.where((language["lang"] != UNDETERMINED) & (language["score"] >= least) & (language["fit"] >= 0)).drop(name)
