"""Log-bilinear language model, trained by noise-contrastive estimation and averaged over Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import rolling
from shelfwise.runtime import spread, staged

# The model predicts one of CLASSES: the end of a text, the TOP most frequent words, and classes of the
# other words by their last bytes. Inside a class the words share its probability by their counts.
TAIL = 128
TOP = 383
CLASSES = 1 + TOP + TAIL
ENDING_BYTES = 3
CONTEXT = 5  # words before the predicted one
WIDTH = 16
NOISE = 48  # noise words per minibatch
BATCH = 4096
RATE = 0.25
ROUNDS = 2  # each round takes its share of the texts of a shard; after it the models of all shards are averaged
# Training tokens of a shard, about: what one model learns from before it is averaged with the others.
SHARD_TOKENS = 400_000
# Words that make up at least one in FREQUENT training tokens, so at most FREQUENT words, go to every task with their
# counts; texts ask for the counts of their other words by a join.
FREQUENT = 1_000_000
SCORED = 512  # rows of outputs at a time: they stay in a core's cache
SAFE = 80.0  # exponents up to here neither overflow nor vanish in 32 bits
END = 0
START = CLASSES  # context before the first word
SEED = 11


class Model:
    """Vectors of context classes, one diagonal weight per context position, output vectors and biases."""

    def __init__(self, context: np.ndarray, position: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.context, self.position, self.output, self.bias = context, position, output, bias

    @classmethod
    def fresh(cls, shares: np.ndarray) -> Model:
        random = np.random.default_rng(SEED)
        context = random.normal(0, 0.3, (CLASSES + 1, WIDTH)).astype(np.float32)
        output = random.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        position = np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)
        return cls(context, position, output, np.log(shares).astype(np.float32))

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.position, self.output, self.bias)])

    @classmethod
    def of(cls, vector: np.ndarray) -> Model:
        sizes = np.cumsum([(CLASSES + 1) * WIDTH, CONTEXT * WIDTH, CLASSES * WIDTH])
        a, b, c, d = np.split(vector.astype(np.float32), sizes)
        return cls(a.reshape(-1, WIDTH), b.reshape(-1, WIDTH), c.reshape(-1, WIDTH), d.copy())

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """Predicted vectors of (n x CONTEXT) class contexts."""
        return np.einsum("ncd,cd->nd", self.context[contexts], self.position)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the targets, by batched products with all outputs."""
        out = np.empty(len(targets), np.float64)
        outputs = np.concatenate([self.output, self.bias[:, None]], axis=1).T.copy()
        longest, highest = np.linalg.norm(self.output, axis=1).max(), np.abs(self.bias).max()
        ones = np.ones(len(self.bias), np.float32)
        for i in range(0, len(targets), SCORED):
            own = targets[i : i + SCORED]
            predicted = np.ones((len(own), WIDTH + 1), np.float32)
            predicted[:, :-1] = self.predicted(contexts[i : i + SCORED])
            score = predicted @ outputs
            if not np.sqrt(np.einsum("nw,nw->n", predicted, predicted).max()) * longest + highest < SAFE:
                score -= score.max(axis=1, keepdims=True)
            own = score[np.arange(len(own)), own].astype(np.float64)
            np.exp(score, out=score)
            out[i : i + SCORED] = own - np.log((score @ ones).astype(np.float64))
        return out


class Trainer:
    """Noise-contrastive estimation with Adagrad, on minibatches that share their noise words."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int):
        self.model, self.random = model, np.random.default_rng(seed)
        self.cumulative = np.cumsum(shares)
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.squares = [np.full(x.shape, 1.0, np.float32) for x in (model.context, model.position, model.output, model.bias)]

    def _step(self, which: int, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | slice) -> None:
        square = self.squares[which]
        square[rows] += gradient * gradient
        value[rows] += RATE * gradient / np.sqrt(square[rows])

    @staticmethod
    def _by_row(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        return rows[edges], np.add.reduceat(gradient.take(order, axis=0), edges, axis=0)

    def learn(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m = self.model
        noise = np.searchsorted(self.cumulative, self.random.random(NOISE) * self.cumulative[-1])
        taken = m.context[contexts]
        r = np.einsum("ncd,cd->nd", taken, m.position)
        q = m.output[targets]
        own = (r * q).sum(axis=1) + m.bias[targets] - self.log_noise[targets]
        other = r @ m.output[noise].T + m.bias[noise] - self.log_noise[noise]
        g_own = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        g_other = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        g_r = g_own[:, None] * q + g_other @ m.output[noise]
        g_context = (g_r[:, None, :] * m.position).reshape(-1, WIDTH)
        g_position = (taken * g_r[:, None, :]).sum(axis=0)
        rows = np.concatenate([targets, noise])
        g_out = np.concatenate([g_own[:, None] * r, g_other.T @ r])
        g_bias = np.concatenate([g_own, g_other.sum(axis=0)])
        scale = np.float32(1 / np.sqrt(len(targets)))
        at, g = self._by_row(rows, np.concatenate([g_out, g_bias[:, None]], axis=1))
        self._step(2, m.output, g[:, :-1] * scale, at)
        self._step(3, m.bias, g[:, -1] * scale, at)
        at, g = self._by_row(contexts.ravel(), g_context)
        self._step(0, m.context, g * scale, at)
        self._step(1, m.position, g_position * scale / CONTEXT, slice(None))


class Vocabulary:
    """Classes of words: the top words by hash, all others by their ending; and the counts of all frequent words."""

    def __init__(self, top: np.ndarray, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.own = np.zeros(len(words), np.int64)  # class of a top word, 0 for others
        self.own[np.searchsorted(self.words, top)] = 1 + np.arange(len(top))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word among the frequent ones, whether it is one)."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def classes(self, at: np.ndarray, known: np.ndarray, endings: np.ndarray) -> np.ndarray:
        own = np.where(known, self.own[at], 0) if len(self.own) else at
        return np.where(own > 0, own, 1 + TOP + endings)


def tokens(texts: pa.Array) -> tuple[rolling.Words, np.ndarray]:
    """Words, and the ending class (0 to TAIL - 1) of each."""
    text = rolling.flat(texts)
    folded = rolling.LOWER_ASCII[text.data]
    words = rolling.find_words(text, rolling.WHITE_SPACE[text.data], folded)
    value = np.zeros(len(words.start), np.uint64)
    for k in range(ENDING_BYTES):
        at = words.end - 1 - k
        byte = folded[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1)
        value = value * np.uint64(257) + np.where(at >= words.start, byte, np.uint64(0))
    return words, (rolling.mix(value) % np.uint64(TAIL)).astype(np.int64)


def _contexts(targets: np.ndarray, since: np.ndarray) -> np.ndarray:
    """The CONTEXT targets before each one, of which `since` stand before it in its text."""
    contexts = np.full((len(targets), CONTEXT), START, np.int64)
    for k in range(1, min(CONTEXT, len(targets) - 1) + 1):
        contexts[k:, k - 1] = np.where(since[k:] >= k, targets[:-k], START)
    return contexts


def with_ends(words: rolling.Words, classes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets with an end per text, row of each, place of the words among the targets)."""
    sizes = np.bincount(words.row, minlength=n_rows) + 1
    inside = np.ones(len(classes) + n_rows, bool)
    inside[np.cumsum(sizes) - 1] = False
    place = np.flatnonzero(inside)
    targets = np.full(len(inside), END, np.int64)
    targets[place] = classes
    return targets, np.repeat(np.arange(n_rows), sizes), place


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) per piece, by hash."""
    for batch in batches:
        for part in rolling.pieces(batch, "text"):
            words, endings = tokens(part.column("text"))
            found, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(endings[at]), pa.array(n, pa.int64())], ["word", "ending", "n"]
            )


def _encode(vocabulary: Vocabulary):
    """Texts as the classes of their tokens, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text"):
                words, endings = tokens(part.column("text"))
                targets, rows, _ = with_ends(words, vocabulary.classes(*vocabulary.find(words.hash), endings), part.num_rows)
                raw = targets.astype(np.uint16)
                offsets = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32) * 2
                values = pa.BinaryArray.from_buffers(
                    pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("tie"), values], ["shard", "tie", "classes"])

    return run


def _contexts_of(targets: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token of whole texts; each text ends with END."""
    ends = np.flatnonzero(targets == END)
    begins = np.concatenate([[0], ends[:-1] + 1])
    return _contexts(targets, np.arange(len(targets)) - np.repeat(begins, ends - begins + 1))


def _train(shares: np.ndarray, start: np.ndarray):
    """Rows sorted by (shard, tie): a model per shard, summed over the shards of the task."""

    def learned(texts: list[bytes]) -> tuple[np.ndarray, int]:
        targets = np.frombuffer(b"".join(texts), np.uint16).astype(np.int64)
        contexts = _contexts_of(targets)
        trainer = Trainer(Model.of(start.copy()), shares, SEED)
        for i in range(0, len(targets), BATCH):
            trainer.learn(contexts[i : i + BATCH], targets[i : i + BATCH])
        return trainer.model.vector(), len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(start)), 0
        shard, texts, held = None, [], 0

        def end() -> None:
            nonlocal total, seen, texts, held
            if texts:
                vector, n = learned(texts)
                total, seen, texts, held = total + vector.astype(np.float64) * n, seen + n, [], 0

        for batch in batches:
            for now, classes in zip(batch["shard"].to_pylist(), batch["classes"].to_pylist(), strict=True):
                # A shard beyond its size (one text in very many copies) is learned in pieces of that size.
                if now != shard or held > 4 * SHARD_TOKENS:
                    end()
                shard = now
                texts.append(classes)
                held += len(classes) // 2
        end()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(start)), pa.int32()), pa.array(total), pa.array(np.full(len(start), float(seen)))],
                ["at", "sum", "weight"],
            )

    return run


def train(docs: DataFrame, vocabulary: Vocabulary, shares: np.ndarray, n_tokens: int) -> np.ndarray:
    """Parameters after one pass over all texts, in ROUNDS rounds.

    Texts are dealt to shards by a hash, of about SHARD_TOKENS tokens each, and a shard is learned in the order of
    another hash: so the result does not depend on partitions. In each round every shard starts from the common
    parameters; what comes back is averaged by tokens, a vector of fixed size, whatever the corpus. Texts travel
    as two bytes a token.
    """
    vector = Model.fresh(shares).vector()
    shards = n_tokens // SHARD_TOKENS + 1
    tie = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")
    dealt = docs.select("text", tie.alias("tie")).withColumn("shard", F.pmod("tie", F.lit(shards)))
    encoded = staged(
        dealt.select("shard", F.xxhash64("tie").alias("tie"), "text").mapInArrow(
            _encode(vocabulary), "shard long, tie long, classes binary"
        ),
        "encoded",
    )
    for r in range(ROUNDS):
        rows = (
            encoded.where(F.pmod("tie", F.lit(ROUNDS)) == r)
            .repartition("shard")
            .sortWithinPartitions("shard", "tie")
            .mapInArrow(_train(shares, vector), "at int, sum double, weight double")
            .groupBy("at")
            .agg((F.sum("sum") / F.sum("weight")).alias("mean"))
            .collect()
        )
        for row in rows:
            vector[row["at"]] = row["mean"]
    return vector


def _score(vocabulary: Vocabulary, vector: np.ndarray, class_totals: np.ndarray, class_sizes: np.ndarray, total: int, distinct: int, ends: int):
    """Per text, the sums over its end and its frequent words, and what its other words add without their counts;
    `asks` and `times` are those other words. Base and score both lack the log10(count + 1) of each of these."""
    model = Model.of(vector)
    log_base = np.log10(total + distinct + 1)
    log_class = np.log10(class_totals + class_sizes + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text"):
                n_rows = part.num_rows
                words, endings = tokens(part.column("text"))
                at, frequent = vocabulary.find(words.hash)
                classes = vocabulary.classes(at, frequent, endings)
                targets, rows, _ = with_ends(words, classes, n_rows)
                score = model.log_probabilities(_contexts_of(targets), targets) / np.log(10)
                asked = np.flatnonzero(~frequent)
                c = np.zeros(len(at))
                c[frequent] = vocabulary.counts[at[frequent]]
                counted = np.log10(c + 1.0)
                # Of a tail class, a word gets count + 1 parts, and unknown words share one part.
                within = np.where(classes > TOP, counted - log_class[classes], 0.0)
                sums = lambda at, x: np.bincount(at, weights=x, minlength=n_rows)
                n_words = np.bincount(words.row, minlength=n_rows)
                own = sums(words.row, counted) + np.log10(ends + 1.0) - (n_words + 1) * log_base
                order = asked[np.lexsort((words.hash[asked], words.row[asked]))]
                h, r = words.hash[order], words.row[order]
                new = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (h != np.roll(h, 1)))
                asks = np.bincount(r[new], minlength=n_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(n_words + 1, pa.int64()),
                        pa.array((np.bincount(words.row[c > 0], minlength=n_rows) + (ends > 0)).astype(np.int64)),
                        pa.array(own),
                        pa.array(sums(rows, score) + sums(words.row, within)),
                        rolling.lists(h[new].view(np.int64), asks, pa.int64()),
                        rolling.lists(np.diff(new, append=len(h)), asks, pa.int64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "asks", "times"],
                )

    return run


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text), learned from the rows that are not held out.

    Tokens are words between ASCII white space with A-Z in lower case, and one end per text. Words are
    known by 64-bit hashes. Counts cover all training texts, and the model trains on all of them; what
    goes to every task is the model, its TOP words and the counts of at most FREQUENT words, of bounded size. The
    network itself tells the end and the TOP words apart; of other words it gives the class, and counts give the
    share within it (on the given tables the network decides alone on about a third of the tokens). Texts are
    scored where they are read, by the network and the frequent words; of its other words each text asks once for
    the count, by a join, and only sums come back. A null text is empty and has its end alone. A null doc_id is not
    held out. Repeated rows are scored and learned one by one. Without training texts all counts are 0 and the model
    is uniform but for its random start.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id"))
    )
    training = rows.where(~F.col("held_out"))
    counts = staged(
        training.select("text").mapInArrow(_count, "word long, ending long, n long")
        .groupBy("word").agg(F.sum("n").alias("n"), F.first("ending").alias("ending")),
        "word-counts",
    )
    ends = training.count()
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(TOP).collect()]
    tail = (
        counts.join(F.broadcast(counts.orderBy(F.desc("n"), "word").limit(TOP).select("word")), "word", "left_anti")
        .groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    )
    totals, sizes = np.zeros(CLASSES), np.zeros(CLASSES)
    totals[END], sizes[END] = ends, 1
    for i, (_, n) in enumerate(top):
        totals[1 + i], sizes[1 + i] = n, 1
    for row in tail:
        totals[1 + TOP + row["ending"]], sizes[1 + TOP + row["ending"]] = row["n"], row["v"]
    total, distinct = int(totals.sum()), int(sizes.sum()) if ends else 0
    shares = (totals + 1) / (totals + 1).sum()
    often = F.col("n") >= total / FREQUENT
    words, n = (np.array(x, np.int64) for x in zip(*top, strict=True)) if top else (np.zeros(0, np.int64),) * 2
    vector = train(training, Vocabulary(words.view(np.uint64), words.view(np.uint64), n), shares, total)

    found = counts.where(often).select("word", "n").toArrow()
    known, at = np.unique(np.concatenate([words, found["word"].to_numpy()]), return_index=True)
    known_n = np.concatenate([n, found["n"].to_numpy()])[at]
    vocabulary = Vocabulary(words.view(np.uint64), known.view(np.uint64), known_n)
    scored = staged(
        spread(rows).mapInArrow(
            _score(vocabulary, vector, totals, sizes, total, distinct, ends),
            f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, "
            "asks array<long>, times array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    answers = (
        scored.select("row", F.explode(F.arrays_zip("asks", "times")).alias("ask"))
        .select("row", F.col("ask.asks").alias("word"), F.col("ask.times").alias("times"))
        .join(counts.where(~often).select("word", "n"), "word")
        .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("counted"))
    )
    more, counted = F.coalesce("more", F.lit(0)), F.coalesce("counted", F.lit(0.0))
    return scored.drop("asks", "times").join(answers, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + counted).alias("base_score"), (F.col("score") + counted).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of `documents`, learned from those that are not held out."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
