"""Token counts under a unigram model, by dynamic programming over a trie of the distinct words.

The model has a probability for each piece of a public byte-level vocabulary, which is taken as it is. The probabilities are estimated
by PASSES of expectation maximisation over all documents: the distinct words of all whole texts are counted; a pass sums the expected
number of times that each piece occurs over all segmentations of each word, and the next probabilities are those sums plus SMOOTHING,
scaled to one. It starts from Zipf's law by rank. The words of a task are in order and form a trie, too: a byte prefix has its
forward sum once, and hands the occurrences that end on it or below it back to its own prefixes once, after all that are longer.

A word's count is the number of tokens of its best segmentation: the highest
sum of log probabilities, of equal ones the fewest tokens. Each batch's distinct pre-tokens (split as by the
vocabulary's pattern) form a trie, whose prefixes are numbered from the sorted words. A depth of it is taken at once: all its prefixes
walk back through the pieces, read backwards, in step, and take the best of the prefixes that a piece leaves; a word's own prefix has
its count. Words of over LONG bytes go one by one: a stack holds the entries of the prefixes on the path, and a word computes only
what it does not share with the word before it.

Defined cases: a null text is an empty text with no words and no tokens; repeated rows give repeated rows; words are
never cut; extra columns are ignored; an empty table gives an empty result, and texts without words the starting model.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept, byte_names, chunks, default_vocabulary, split_all, words_of
from .common import kept_model, map_slices, work_dir, written


#: Words whose terminal counts a process keeps (twice: of late, and from before).
KEPT = 200_000


#: How often probabilities are estimated, and what each piece is given on top.
PASSES, SMOOTHING = 2, 0.1
#: Distinct words a task of a pass has, about; and how deep a path's arcs are held (below, they are found twice).
TASK_WORDS, HELD_DEPTH = 100_000, 10_000
#: Words whose prefixes are taken together, and the bytes beyond which a word goes by itself.
GROUP, LONG = 50_000, 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Unigram:
    def __init__(self, text: str, weights: np.ndarray | None = None):
        """`weights`: one a piece, in the order of their numbers; by default Zipf's."""
        names = byte_names()
        vocabulary = json.loads(text)["model"]["vocab"]
        pieces = sorted((i, token) for token, i in vocabulary.items() if all(c in names for c in token))
        weights = np.array([1 / (i + 1) for i, _ in pieces]) if weights is None else weights
        logs = np.log(weights / weights.sum()).tolist()
        self.tree: dict = {}  # the pieces, read backwards
        self.kept = Kept(KEPT)
        self.pieces: dict[bytes, float] = {}
        for n, (_, token) in enumerate(pieces):
            piece = bytes(names[c] for c in token)
            self.pieces[piece] = logs[n]
            node = self.tree
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1], node[-2] = logs[n], n
        self._flatten()

    def _flatten(self) -> None:
        """The tree as arrays: states are numbered by depth (0: the root, and none); arcs of the first are a table, the others hashed."""
        nodes, froms, labels, depth1 = [self.tree], [], [], 0
        for state, node in enumerate(nodes):  # grows meanwhile
            for b, child in node.items():
                if b >= 0:
                    froms.append(state)
                    labels.append(b)
                    nodes.append(child)
            depth1 = depth1 or len(nodes)
        self.logs = np.array([node.get(-1, -math.inf) for node in nodes])
        self.numbers = np.array([node.get(-2, 0) for node in nodes])
        keys, targets = np.array(froms, np.int64) << 8 | np.array(labels, np.int64), np.arange(1, len(nodes))
        self.near = np.zeros(depth1 << 8, np.int64)
        low = keys < depth1 << 8
        self.near[keys[low]] = targets[low]
        keys, targets = keys[~low], targets[~low]
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.hashed, self.target = np.uint64(64 - bits), np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        slot = self._slots(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            put = first[self.hashed[slot[first]] < 0]
            self.hashed[slot[put]], self.target[slot[put]] = keys[put], targets[put]
            keys, targets, slot = (np.delete(x, put) for x in (keys, targets, slot))
            slot = slot + 1 & len(self.hashed) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _GOLDEN >> self.shift).astype(np.int64)

    def _after(self, state: np.ndarray, byte: np.ndarray, deep: bool) -> np.ndarray:
        """The states that arcs lead to; 0 for none."""
        keys = state << 8 | byte
        if not deep:
            return self.near[keys]
        slot = self._slots(keys)
        out, there = self.target[slot], self.hashed[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        out[there < 0] = 0
        while len(open_):
            slot[open_] = slot[open_] + 1 & len(self.hashed) - 1
            there = self.hashed[slot[open_]]
            out[open_] = np.where(there < 0, 0, self.target[slot[open_]])
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return out

    def _ends(self, first: int, last: int, parent: np.ndarray, byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(prefix less `first`, prefix before the piece, state) of the pieces that end prefixes first to last, the shortest first."""
        at = np.arange(first, last)
        rows, state, step = at - first, np.zeros(last - first, np.int64), 0
        while len(rows):
            state = self._after(state, byte[at], step > 1)
            at, step = parent[at], step + 1
            has = np.flatnonzero(self.logs[state] > -math.inf)
            yield rows[has], at[has], state[has]
            go = np.flatnonzero((state > 0) & (at > 0))
            rows, at, state = rows[go], at[go], state[go]

    def arcs(self, data: bytes, end: int) -> list[tuple[int, float, int]]:
        """(start, log probability, number) of the pieces that end with the byte at `end`."""
        node, found = self.tree, []
        for at in range(end, -1, -1):
            node = node.get(data[at])
            if node is None:
                break
            p = node.get(-1)
            if p is not None:
                found.append((at, p, node[-2]))
        return found

    def expected(self, words: dict[str, int]) -> np.ndarray:
        """How often each piece occurs in the words (times their counts), over all segmentations by their probability."""
        return self.expected_in(sorted((w.encode("utf-8", "surrogatepass"), n) for w, n in words.items()))

    def expected_in(self, words: Iterable[tuple[bytes, int]]) -> np.ndarray:
        """`expected` of words as bytes. Any order is right; where they are sorted, each common prefix is computed once."""
        out, long, words = np.zeros(len(self.pieces)), [], iter(words)
        while group := list(islice(words, GROUP)):
            long += [x for x in group if len(x[0]) > LONG]
            out += self._expected_of([x for x in group if len(x[0]) <= LONG])
            if sum(len(x[0]) for x in long) > GROUP * LONG:
                out += self._expected_long(long)
                long = []
        return out + self._expected_long(long)

    def _expected_of(self, words: list[tuple[bytes, int]]) -> np.ndarray:
        """`expected_in` by columns: a depth of all words' prefixes at once."""
        parent, byte, depths, ends = _prefixes([x[0] for x in words])
        forward, arcs = np.full(len(parent), -math.inf), []
        forward[0] = 0
        for first, last in depths:
            found = list(self._ends(first, last, parent, byte))
            top, total = np.full(last - first, -math.inf), np.zeros(last - first)
            for rows, at, state in found:
                top[rows] = np.maximum(top[rows], forward[at] + self.logs[state])
            for rows, at, state in found:
                total[rows] += np.exp(forward[at] + self.logs[state] - top[rows])
            forward[first:last] = top + np.log(total)
            arcs.append(found)
        share = np.bincount(ends, [x[1] for x in words], len(parent))
        states, sums = [np.empty(0, np.int64)], [np.empty(0)]
        for (first, last), found in zip(depths[::-1], arcs[::-1], strict=True):
            for rows, at, state in found:
                x = share[rows + first] * np.exp(forward[at] + self.logs[state] - forward[rows + first])
                np.add.at(share, at, x)
                states.append(state)
                sums.append(x)
        return np.bincount(self.numbers[np.concatenate(states)], np.concatenate(sums), len(self.pieces))

    def _expected_long(self, words: list[tuple[bytes, int]]) -> np.ndarray:
        """The same for words of many bytes: one after the other."""
        out = [0.0] * len(self.pieces)
        forward, share, held, before = [0.0], [0.0], [[]], b""

        def leave(depth: int) -> None:
            for end in range(len(share) - 1, depth, -1):
                here, mine, sum_ = held.pop(), share.pop(), forward.pop()
                for at, p, n in self.arcs(before, end - 1) if here is None else here:
                    x = mine * math.exp(forward[at] + p - sum_)
                    share[at] += x
                    out[n] += x

        for data, many in words:
            same = 0
            if data[:1] == before[:1]:
                for x, y in zip(before, data, strict=False):
                    if x != y:
                        break
                    same += 1
            leave(same)
            for end in range(same, len(data)):
                found = self.arcs(data, end)
                if len(found) == 1:
                    forward.append(forward[found[0][0]] + found[0][1])
                else:
                    sums = [forward[at] + p for at, p, _ in found]
                    top = max(sums)
                    forward.append(top + math.log(sum([math.exp(x - top) for x in sums])))
                held.append(found if end < HELD_DEPTH else None)
                share.append(0.0)
            share[-1] += many
            before = data
        leave(0)
        return np.array(out)

    def known(self, words: set[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of at least these words."""
        self.kept.update(self.terminals(self.kept.lack(words)))
        return self.kept

    def terminals(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of each word; the words' shared prefixes are scored once, those of a depth together."""
        pairs = [(w.encode("utf-8", "surrogatepass"), w) for w in sorted(words)]
        out = self._terminals_long([x for x in pairs if len(x[0]) > LONG])
        pairs = [x for x in pairs if len(x[0]) <= LONG]
        for k in range(0, len(pairs), GROUP):
            group = pairs[k : k + GROUP]
            parent, byte, depths, ends = _prefixes([x[0] for x in group])
            scores, counts = np.zeros(len(parent)), np.zeros(len(parent), np.int64)
            for first, last in depths:
                best, few = np.full(last - first, -math.inf), np.zeros(last - first, np.int64)
                for rows, at, state in self._ends(first, last, parent, byte):
                    s, c = scores[at] + self.logs[state], counts[at] + 1
                    now = best[rows]
                    better = np.flatnonzero((s > now) | (s == now) & (c < few[rows]))
                    best[rows[better]], few[rows[better]] = s[better], c[better]
                scores[first:last], counts[first:last] = best, few
            out.update(zip((x[1] for x in group), zip(counts[ends].tolist(), scores[ends].tolist(), strict=True), strict=True))
        return out

    def _terminals_long(self, words: list[tuple[bytes, str]]) -> dict[str, tuple[int, float]]:
        """`terminals` of words of many bytes, in order: one after the other."""
        tree, out = self.tree, {}
        scores, counts, before = [0.0], [0], b""
        for data, word in words:
            shared = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                shared += 1
            del scores[shared + 1 :], counts[shared + 1 :]
            for end in range(shared, len(data)):
                best, few, node = -math.inf, 0, tree
                for at in range(end, -1, -1):
                    node = node.get(data[at])
                    if node is None:
                        break
                    p = node.get(-1)
                    if p is not None:
                        s = scores[at] + p
                        if s > best or s == best and counts[at] + 1 < few:
                            best, few = s, counts[at] + 1
                scores.append(best)
                counts.append(few)
            out[word] = (counts[-1], scores[-1])
            before = data
        return out


def _prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """The words' distinct prefixes, numbered by depth from 0, the empty one: (each one's parent, its last byte, the first and the end
    of each depth, each word's own). Words out of order are right, but share less."""
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(x) for x in words], np.int64)
    starts, own, live = np.cumsum(sizes) - sizes, np.zeros(len(words), np.int64), np.arange(len(words))
    parents, bytes_, depths, many = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 1
    while len(live := live[sizes[live] > len(depths)]):
        up, byte = own[live], data[starts[live] + len(depths)].astype(np.int64)
        new = np.ones(len(live), bool)
        new[1:] = (up[1:] != up[:-1]) | (byte[1:] != byte[:-1])
        own[live] = many - 1 + np.cumsum(new)
        parents.append(up[new])
        bytes_.append(byte[new])
        depths.append((many, many := many + len(parents[-1])))
    return np.concatenate(parents), np.concatenate(bytes_), depths, own


def _model(shared) -> Unigram:
    """The model of a broadcast (vocabulary text, weights or None), made once a worker."""
    return kept_model(shared.value, lambda: Unigram(*shared.value))


def _word_counts(texts: list[str]) -> dict[str, int]:
    cut = [chunks(x) for x in texts]
    many = Counter(chain.from_iterable(c[1:] for c in cut))
    out = defaultdict(int, Counter(w for c in cut if c[0] for w in words_of(c[0])))
    for c, words in split_all(many).items():
        n = many[c]
        for w in words:
            out[w] += n
    return out


def fit(docs: DataFrame, vocabulary: str, text: str = "text", passes: int = PASSES) -> np.ndarray | None:
    """The pieces' weights from all texts; the driver holds one number a piece. None where no text has words."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        given = file.read()

    def counted(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        words = _word_counts(texts)
        return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    found = map_slices(docs.select(F.col(text).alias("text")), counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(found, f"{work_dir(spark, 'unigram')}/words")
    tasks = max(8, words.count() // TASK_WORDS)
    weights = None
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((given, weights))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _model(shared).expected_in((w, n) for batch in batches for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "x"])

        dealt = words.repartition(tasks, "word").sortWithinPartitions("word")
        # Sums are rounded, so that the order in which tasks end does not show.
        sums = dealt.mapInArrow(expected, "piece long, x double").groupBy("piece").agg(F.round(F.sum("x"), 6).alias("x")).collect()
        if not sums:
            return None
        weights = np.full(len(Unigram(given).pieces) if weights is None else len(weights), SMOOTHING)
        for r in sums:
            weights[r["piece"]] += r["x"]
        shared.unpersist()
    return weights


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens, score (of the best segmentation, to 3 digits) of each whole text, under the weights or
    those of `fit`."""
    weights = fit(docs, vocabulary, text) if weights is None else weights
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), weights))

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        model = _model(shared)
        cut = [chunks(x) for x in texts]
        heads = {c[0]: words_of(c[0]) if c[0] else [] for c in cut}
        parts = split_all(set().union(*(c[1:] for c in cut)))
        known = model.known({w for ws in [*heads.values(), *parts.values()] for w in ws})
        sums = {c: (1, *known[ws[0]]) if len(ws) == 1 else (len(ws), sum([known[w][0] for w in ws]), sum([known[w][1] for w in ws])) for c, ws in parts.items()}
        rows = []
        for c in cut:
            rest = [sums[x] for x in c[1:]]
            first = [(1, *known[w]) for w in heads[c[0]]]
            n, tokens, scores = zip(*first, *rest, strict=True) if first or rest else ((), (), ())
            rows.append((sum(n), sum(tokens), round(math.fsum(scores), 3) + 0.0))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], names=["doc_id", "n_words", "n_tokens", "score"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), of, "doc_id long, n_words long, n_tokens long, score double", model=True)


def op8_unigram_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or default_vocabulary())
