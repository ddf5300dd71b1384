"""Operator 2, masked pseudo-likelihood by a bidirectional window network, trained in numpy.

The network sees two tokens on either side, sums their embeddings (one table for each place), applies tanh, and predicts the token
between in two steps, its class and then itself among the class. A text's score is the sum of all its words' conditional
log-probabilities. Tokens are the commonest words, and buckets by ending for all others; a word of a bucket has the bucket's
probability times its own share of the bucket, from the counts of all words and, for words never counted, from a model of spelling:
P(word | bucket) = (n(word) + kinds(bucket) * spelled(word | bucket)) / (n(bucket) + kinds(bucket)). So every word there is has a probability of its own, and those
of a place sum to 1 (or a little less, as spellings of the commonest words are not taken out).

Training is data-parallel: texts fall into groups by their rows' hashes, each round every group trains on the masked places of its texts
from the common parameters, and Spark averages the groups' parameters row by row, weighted by places. Groups depend on the rows alone, so
that it doesn't matter how these are dealt to tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, settle, with_results

#: Words of the vocabulary; buckets for all others; classes of tokens; values of an embedding; places of the window.
WORDS, BUCKETS, CLASSES, DIM, PLACES = 1983, 64, 45, 16, (-2, -1, 1, 2)
#: Each round masks every ROUNDS-th place, so that all rounds together mask each place once; tokens of a training group, about.
ROUNDS, GROUP = 2, 4_000_000
#: Counts of up to so many words are broadcast; those of rarer words are met in a join.
KNOWN = 1 << 17
RATE, BATCH, CHUNK = 0.2, 4096, 16_384
_PAD = 0  # the token beyond a text's ends
_BEGIN = 256  # what stands before a word's first byte
_APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


def word_counts(df: DataFrame, text: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) over all rows; each task sums what it can hold before Spark's shuffle sums the rest."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                n.update(words_of(t))
                if len(n) > flush:
                    yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})
                    n.clear()
        yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())}, columns=["word", "n"])

    return df.select(quoted(text).cast("string").alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, pair, ending, bucket) of words that have a byte.

    pair: of each byte, from a word's `first` on, the number of the byte before it and itself; a word's last pair is its ending, by which it falls into a bucket.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    own = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    before = np.concatenate(([0], own[:-1])) if len(own) else own
    before[ends - sizes] = _BEGIN
    pair = before * 256 + own
    ending = pair[ends - 1]
    return ends - sizes, pair, ending, bucket_of(ending)


def bucket_of(ending: np.ndarray) -> np.ndarray:
    return (ending * 2654435761 & 0xFFFFFFFF) >> 26


_PAIRS = 257 * 256
assert BUCKETS == 64  # what bucket_of gives


@dataclass
class Spellings:
    """Each bucket's words and kinds of words, and logarithms of an ending's share of its bucket and of a byte's probability before another one."""

    n: np.ndarray
    kinds: np.ndarray
    ending: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, endings: np.ndarray, pairs: np.ndarray) -> Spellings:
        """From sums over words beyond the vocabulary: of n by bucket, of kinds of words by ending, and by pair without the endings."""
        bucket = bucket_of(np.arange(_PAIRS))
        kinds = np.bincount(bucket, endings, BUCKETS)
        ending = np.log((endings + 0.01) / (kinds + 0.01 * np.bincount(bucket, minlength=BUCKETS))[bucket])
        square = pairs.reshape(257, 256) + 0.1
        return cls(n, kinds, ending, np.log(square / square.sum(axis=0)).ravel())

    def logs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, log spelled(word | bucket)): from the ending backwards to the beginning."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        first, pair, ending, bucket = spelling(words)
        each = self.before[pair]
        each[np.append(first[1:], len(pair)) - 1] = self.ending[ending]
        return bucket, np.add.reduceat(each, first)


@dataclass
class Vocabulary:
    """Token 0 lies beyond the ends, then the words, then the buckets.

    index: numbers of known words, those of the vocabulary first. token and share: of each number, the token and log P(word | token).
    counts: of each token; words: (word, n) of all words, of which those of up to `limit` occurrences may not be known.
    """

    index: dict[bytes, int]
    token: np.ndarray
    share: np.ndarray
    spellings: Spellings
    counts: np.ndarray
    limit: int
    words: DataFrame

    @property
    def size(self) -> int:
        return len(self.counts)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From `counts`: the WORDS commonest words (ties by their bytes), the sums by bucket and spelling of all others, and the known words.

    Known are all words with more than `limit` occurrences, the least limit by which there are KNOWN at most (in steps of an 88th part of a doubling).
    """
    step = lambda n: F.floor(F.log2(n) * 64).cast("int")
    # binned, so that a few thousand rows come to the driver
    bins = sorted(((r.b, r.words, r.most) for r in counts.groupBy(step(F.col("n")).alias("b")).agg(F.count("*").alias("words"), F.max("n").alias("most")).collect()), reverse=True)
    total, limit = 0, 0
    for _, words, most in bins:
        if total + words > KNOWN:
            limit = most
            break
        total += words
    known = sorted(((-r.n, bytes(r.word)) for r in counts.where(F.col("n") > limit).collect()))
    if len(known) < WORDS and limit:  # a great tie at the top
        top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
        known = [(-r.n, bytes(r.word)) for r in top]
    top = known[:WORDS]
    common = counts.sparkSession.sparkContext.broadcast({w for _, w in top})

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, endings, pairs = np.zeros(BUCKETS, np.int64), np.zeros(_PAIRS, np.int64), np.zeros(_PAIRS, np.int64)
        for batch in batches:
            rest = [(w, k) for w, k in zip(map(bytes, batch["word"]), batch["n"]) if w not in common.value]
            if rest:
                first, pair, ending, bucket = spelling([w for w, _ in rest])
                n += np.bincount(bucket, [k for _, k in rest], BUCKETS).astype(np.int64)
                endings += np.bincount(ending, minlength=_PAIRS)
                pairs += np.bincount(pair, minlength=_PAIRS)
        pairs -= endings
        whole = np.concatenate([n, endings, pairs])
        used = np.flatnonzero(whole)
        yield pd.DataFrame({"at": used, "n": whole[used]})

    got = counts.mapInPandas(spell, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    whole = np.zeros(BUCKETS + 2 * _PAIRS, np.int64)
    whole[got["at"].to_numpy(np.int64)] = got["n"]
    spellings = Spellings.of(*np.split(whole, [BUCKETS, BUCKETS + _PAIRS]))
    rest = [w for _, w in known[WORDS:]]
    bucket, logs = spellings.logs(rest)
    n = np.array([-k for k, _ in known[WORDS:]], np.float64)
    share = np.log((n + spellings.kinds[bucket] * np.exp(logs)) / (spellings.n + spellings.kinds)[bucket]) if rest else np.zeros(0)
    token = np.concatenate([1 + np.arange(len(top)), 1 + len(top) + bucket]).astype(np.uint16)
    sizes = np.array([0, *(-k for k, _ in top), *np.maximum(1, spellings.n)], np.int64)
    return Vocabulary({w: i for i, (_, w) in enumerate(known)}, token, np.concatenate([np.zeros(len(top)), share]), spellings, sizes, limit, counts)


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """A class for each token, of about equal sums of roots of counts; token 0 has none (-1)."""
    order = 1 + np.argsort(-counts[1:], kind="stable")
    mass = np.sqrt(counts[order].astype(np.float64))
    out = np.full(len(counts), -1)
    out[order] = np.unique(np.minimum(classes - 1, np.cumsum(mass) * classes / max(mass.sum(), 1e-9)).astype(int), return_inverse=True)[1]
    return out


class Network:
    """Parameters in one table: PLACES embeddings for each token, then a vector and a bias for each class and for each token in its class."""

    def __init__(self, counts: np.ndarray, table: np.ndarray | None = None, classes: int = CLASSES):
        self.counts, self.size = counts, len(counts)
        self.of = classes_of(counts, classes)
        self.order = np.argsort(self.of, kind="stable")[1:]  # tokens by class, without token 0
        self.place = np.zeros(self.size, np.int64)
        self.place[self.order] = np.arange(self.size - 1)
        self.classes = int(self.of.max(initial=-1)) + 1
        self.cuts = np.searchsorted(self.of[self.order], np.arange(self.classes + 1))
        self.place -= np.where(self.of >= 0, self.cuts[np.maximum(self.of, 0)], 0)  # within the class
        a = len(PLACES) * self.size
        b = a + self.classes
        if table is None:
            table = np.zeros((b + self.size - 1, DIM + 1), np.float32)
            table[:a, :DIM] = np.random.default_rng(2).normal(0, 0.3, (a, DIM))
            own = np.maximum(1, counts[self.order]).astype(np.float64)
            mass = np.add.reduceat(own, self.cuts[:-1]) if len(own) else np.zeros(0)
            table[a:b, DIM] = np.log(mass / max(1.0, mass.sum()))
            table[b:, DIM] = np.log(own / np.repeat(mass, np.diff(self.cuts)))
        self.table, self.inputs, self.first, self.second = table, table[:a], table[a:b], table[b:]

    def hidden(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        around = np.stack([tokens[at + p] + k * self.size for k, p in enumerate(PLACES)], 1)
        total = self.inputs[around[:, 0], :DIM]
        for k in range(1, len(PLACES)):
            total += self.inputs[around[:, k], :DIM]
        return around, np.tanh(total)

    @staticmethod
    def softmax(hidden: np.ndarray, outputs: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of all outputs, log-probability of the wanted one)."""
        score = hidden @ outputs[:, :DIM].T
        score += outputs[:, DIM]
        score -= score.max(axis=1, keepdims=True)
        own = score[np.arange(len(want)), want]
        np.exp(score, out=score)
        total = score.sum(axis=1, keepdims=True)
        score /= total
        return score, own - np.log(total[:, 0])

    def by_class(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, places whose target is in it)."""
        of = self.of[target].astype(np.uint8)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            yield c, order[cuts[c] : cuts[c + 1]]

    def log_probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at `at`, each given those around it."""
        out = np.zeros(len(at))
        for k in range(0, len(at), CHUNK):
            own = at[k : k + CHUNK]
            _, hidden = self.hidden(tokens, own)
            target = tokens[own]
            logs = self.softmax(hidden, self.first, self.of[target])[1].astype(np.float64)
            for c, rows in self.by_class(target):
                logs[rows] += self.softmax(hidden[rows], self.second[self.cuts[c] : self.cuts[c + 1]], self.place[target[rows]])[1]
            out[k : k + CHUNK] = logs
        return out

    def train(self, tokens: np.ndarray, at: np.ndarray, memory: np.ndarray) -> None:
        """One pass of Adagrad over the places `at`, BATCH at a time."""
        a, b = len(self.inputs), len(self.inputs) + self.classes

        def move(rows: slice | np.ndarray, gradient: np.ndarray) -> None:
            memory[rows] += gradient * gradient
            self.table[rows] += RATE * gradient / np.sqrt(memory[rows] + 1e-6)

        def step(where: slice, hidden: np.ndarray, want: np.ndarray) -> np.ndarray:
            """Moves some outputs; returns the gradient to the hidden values."""
            outputs = self.table[where]
            p, _ = self.softmax(hidden, outputs, want)
            np.negative(p, out=p)
            p[np.arange(len(want)), want] += 1
            back = p @ outputs[:, :DIM]
            move(where, np.concatenate([p.T @ hidden, p.sum(axis=0)[:, None]], 1))
            return back

        for k in range(0, len(at), BATCH):
            own = at[k : k + BATCH]
            around, hidden = self.hidden(tokens, own)
            target = tokens[own]
            back = step(slice(a, b), hidden, self.of[target])
            for c, rows in self.by_class(target):
                back[rows] += step(slice(b + self.cuts[c], b + self.cuts[c + 1]), hidden[rows], self.place[target[rows]])
            back *= 1 - hidden**2
            flat = around.T.ravel().astype(np.uint16 if len(self.inputs) < 1 << 16 else np.int64)
            order = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
            gradient = np.add.reduceat(back[order % len(own)], cuts)
            move(flat[order[cuts]].astype(np.int64), np.pad(gradient, ((0, 0), (0, 1))))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts in a row, two of _PAD between texts and at both ends, and each text's number of tokens."""
    gap = bytes(4)
    whole = gap + gap.join(texts) + gap
    return np.frombuffer(whole, np.uint16).astype(np.int64), np.array([len(t) // 2 for t in texts], np.int64)


def runs(texts: list, size: int, length=len) -> Iterator[list]:
    """Consecutive pieces of `texts` of about `size`, one text at least."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += length(t)
        if n >= size:
            yield own
            own, n = [], 0
    if own:
        yield own


@dataclass
class Tokens:
    """rows: the input's columns but the text, with `cut` (token numbers, two bytes each), `share` (the sum of known words' log P(word |
    token)), and columns named `row` (a number) and `group`. rare: (row, share) for rows with words that only the join knows."""

    rows: DataFrame
    rare: DataFrame
    row: str
    group: str


def tokenized(df: DataFrame, text: str = "text", v: Vocabulary | None = None) -> tuple[Tokens, Vocabulary]:
    """The tokens of `df`, in a checkpoint, and the vocabulary of all its words.

    A text is cut into words twice, for the counts and here. With `v`, that vocabulary's words and counts are taken instead of the
    counts of `df`. Null texts have no tokens.
    """
    v = v or vocabulary(settle(word_counts(df, text)))
    common = df.sparkSession.sparkContext.broadcast((v.index, v.token, v.share, v.spellings, v.size))

    @F.pandas_udf("cut binary, share double, words array<binary>, bases array<double>, units array<double>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, token, share, s, size = common.value
        number = _Numbers(index).__getitem__
        unit = 1 / np.maximum(1, s.n + s.kinds)
        token, share = np.append(token, np.uint16(0)), np.append(share, 0.0)  # of -1
        for texts in batches:
            out = [pd.DataFrame({c: [] for c in ("cut", "share", "words", "bases", "units")})]
            for some in runs(texts.to_list(), 400_000, lambda t: len(t or "") + 1):
                own = [words_of(t) for t in some]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                ends = np.cumsum(sizes)
                flat = [w for ws in own for w in ws]
                numbers = np.fromiter(map(number, flat), np.int64, len(flat))
                at = np.flatnonzero(numbers < 0)
                rare = [flat[i] for i in at.tolist()]
                bucket, logs = s.logs(rare)
                tokens = token[numbers]
                tokens[at] = size - BUCKETS + bucket
                sums = np.bincount(np.repeat(np.arange(len(own)), sizes), share[numbers], len(own))
                base = s.kinds[bucket] * np.exp(logs) * unit[bucket]
                a, b = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
                cuts = [tokens[x:y].tobytes() for x, y in zip(ends - sizes, ends)]
                spans = list(zip(a.tolist(), b.tolist()))
                out.append(pd.DataFrame({"cut": cuts, "share": sums, "words": [rare[x:y] for x, y in spans], "bases": [base[x:y] for x, y in spans], "units": [unit[bucket[x:y]] for x, y in spans]}))
            yield pd.concat(out[1:] or out)

    kept = [quoted(c) for c in df.columns if c != text]
    row, group, t = fresh("row"), fresh("group"), fresh("t")
    hashed = F.xxhash64(*(quoted(c) for c in df.columns))
    rows = settle(df.select(*kept, cut(quoted(text).cast("string")).alias(t), F.monotonically_increasing_id().alias(row), hashed.alias(group)))
    each = rows.where(F.size(f"{t}.words") > 0).select(row, F.explode(F.arrays_zip(f"{t}.words", f"{t}.bases", f"{t}.units")).alias("w"))
    each = each.select(row, F.col("w.words").alias("word"), F.col("w.bases").alias("base"), F.col("w.units").alias("unit"))
    # words up to the limit alone, so that no word meets more than `limit` rows of these texts
    logs = F.log(F.col("base") + F.coalesce("n", F.lit(0)) * F.col("unit"))
    met = each.join(v.words.where(F.col("n") <= v.limit), "word", "left")
    rare = met.groupBy(row).agg((F.sum(F.round(logs * 1e6).cast("long")) / 1e6).alias("share"))  # whole millionths: in any order the same
    return Tokens(rows.select(*kept, F.col(f"{t}.cut").alias(t), F.col(f"{t}.share").alias(f"{t}s"), row, group), rare, row, group), v


def fit(tokens: Tokens, v: Vocabulary) -> Network:
    """A network trained on all rows of `tokens`: each place of every text in one of ROUNDS rounds.

    Rows are dealt to groups of about GROUP tokens by their hashes, and in a group stand in that order. What groups send grows with the
    input, a table of parameters each; sums by parameter row go over a shuffle, and the driver gets one such table. No rows: a network
    with its first parameters.
    """
    network = Network(v.counts)
    cut = _cut_column(tokens)
    size = tokens.rows.agg(F.coalesce(F.sum(F.length(cut)), F.lit(0))).first()[0] // 2
    groups = max(1, math.ceil(size / GROUP))
    rows = tokens.rows.where(F.length(cut) > 0).select(F.pmod(F.col(tokens.group), F.lit(groups)).alias("group"), F.col(tokens.group).alias("hash"), F.col(cut).alias("cut"))
    rows = rows.repartition("group").sortWithinPartitions("group", "hash", "cut")
    names = [f"v{j}" for j in range(DIM + 1)]
    for round_ in range(ROUNDS):
        common = rows.sparkSession.sparkContext.broadcast((v.counts, network.table))

        def shard(batches: Iterator[pd.DataFrame], common=common, round_=round_) -> Iterator[pd.DataFrame]:
            state: list = []  # group, network, memory, places seen, texts not trained on yet and their tokens

            def train() -> None:
                _, own, memory, _, texts, _ = state
                tokens, _ = padded(texts)
                at = np.flatnonzero(tokens != _PAD)[round_::ROUNDS]
                at = np.random.default_rng(len(at)).permutation(at)
                own.train(tokens, at, memory)
                state[3] += len(at)
                state[4:] = [], 0

            def close() -> pd.DataFrame:
                if state[4]:
                    train()
                _, own, memory, seen, _, _ = state
                used = np.flatnonzero(memory.any(axis=1))
                return pd.DataFrame((own.table[used] - common.value[1][used]).astype(np.float64) * seen, columns=names).assign(at=used, n=seen)

            for batch in batches:
                for group, text in zip(batch["group"].tolist(), batch["cut"]):
                    if state and state[0] != group:
                        yield close()
                        state.clear()
                    if not state:
                        own = Network(common.value[0], common.value[1].copy())
                        state[:] = [group, own, np.zeros_like(own.table), 0, [], 0]
                    state[4].append(text)
                    state[5] += len(text) // 2
                    if state[5] >= 300_000:
                        train()
            if state:
                yield close()

        schema = ", ".join(f"{x} double" for x in names) + ", at long, n long"
        own = rows.mapInPandas(shard, schema).groupBy("at").agg(*(F.sum(x).alias(x) for x in names), F.sum("n").alias("n")).toPandas()
        common.unpersist()
        # a row moves by the mean over the places of the groups that met it
        network.table[own["at"].to_numpy(np.int64)] += (own[names].to_numpy() / own["n"].to_numpy()[:, None]).astype(np.float32)
    return network


def _cut_column(tokens: Tokens) -> str:
    return tokens.rows.columns[-4]


def score(tokens: Tokens, network: Network) -> DataFrame:
    """The rows of `tokens` with `n_words`, `log_likelihood` (the sum over all words, natural logarithm) and `mean_log_likelihood`.

    The network's part is a map over rows with the parameters broadcast; rare words' shares are joined by row. No words (null and empty
    texts): 0, 0.0 and null. Very long texts are scored whole, in pieces. Input columns named as a result are replaced; repeated rows
    get equal results to a millionth a word, as a text's tokens see only that text. An empty table gives an empty one.
    """
    common = tokens.rows.sparkSession.sparkContext.broadcast((network.counts, network.table))
    names = ["n_words", "log_likelihood", "mean_log_likelihood"]

    @F.pandas_udf("n_words long, log_likelihood double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Network(*common.value)
        for texts in batches:
            out = [pd.DataFrame({"n_words": [], "log_likelihood": []})]
            for some in runs(texts.to_list(), 600_000):
                cut, sizes = padded(some)
                logs = own.log_probabilities(cut, np.flatnonzero(cut != _PAD))
                out.append(pd.DataFrame({"n_words": sizes, "log_likelihood": np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))}))
            yield pd.concat(out[1:] or out)

    cut = _cut_column(tokens)
    s, rare = fresh("s"), fresh("rare")
    kept = tokens.rows.columns[:-4]
    got = tokens.rows.select(*map(quoted, kept), tokens.row, F.col(f"{cut}s").alias(f"{s}k"), scored(cut).alias(s))
    got = got.join(tokens.rare.select(F.col(tokens.row).alias(rare), F.col("share").alias(f"{rare}s")), F.col(tokens.row) == F.col(rare), "left")
    total = F.col(f"{s}.log_likelihood") + F.col(f"{s}k") + F.coalesce(f"{rare}s", F.lit(0.0))
    n = F.col(f"{s}.n_words")
    result = F.struct(n.alias("n_words"), total.alias("log_likelihood"), F.when(n > 0, total / n).alias("mean_log_likelihood"))
    return with_results(got, result, names).select(*(quoted(c) for c in kept if c.lower() not in names), *names)
