"""Byte-pair encoding and decoding by an automaton compiled from the merges.

The automaton accepts exactly the token strings that the merges produce. It starts as one state with an arc for each
byte; the merges are then applied in order, each as a gadget. The gadget of merge k, (u, v) -> w,
  * takes the arc v away from the state that u leads to,
  * adds an arc w to every state that still has an arc u, and
  * lets w lead to the state that v led to before k.
An arc's target depends on its label alone, so a state is a token, and the whole table is three numbers a gadget: the
pair it removes, the state it copies and the label it copies. `follows` reads an arc from this table by going back
through the gadgets, latest first, and keeps it. Encoding runs a pre-split word through the arcs: of the tokens
that end at a byte at most one can follow the state before it, so each byte has one state at most, which depends on the
bytes up to it alone, and the tokens are read back from the last one. Decoding emits the arcs' labels.

Defined cases: a null text is an empty text and has no tokens; the added token's string is that token; words are
never cut, however long; repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_model, map_slices

#: The splitting pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_find = regex.compile(PATTERN).findall
_plain_cuts = re.compile(r"(?<=\S) (?=\S)").split
#: White space other than the space and the line feed.
_RARE_SPACE = tuple(chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n")
_MARKS = frozenset(".,;:!?")
#: Words, and half as many chunks, whose ids a process keeps (twice: of late, and from before).
KEPT = 200_000
#: Characters of those keys, about.
KEPT_CHARS = 8_000_000


def chunks(text: str) -> list[str]:
    """Cuts at each single space between two other characters, where a word of PATTERN always ends; joined by a space they give the text."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE_SPACE):
        return _plain_cuts(text)
    return text.split(" ")


class Kept(dict):
    """A dict of bounded size, by entries and by their keys' characters: when it is full it starts anew, and what it held is looked
    up in `old` until it is full again. Keys that are long by themselves are not kept beyond the next call."""

    def __init__(self, most: int, chars: int = KEPT_CHARS):
        super().__init__()
        self.most, self.chars, self.size, self.old = most, chars, 0, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def lack(self, keys: Iterable) -> list:
        """Makes room for the keys, and gives those that are not held."""
        keys = list(keys)
        fresh = sum(map(len, keys))
        if len(self) and (len(self) + len(keys) > self.most or self.size + fresh > self.chars):
            self.old = dict(self) if self.size <= self.chars else {}
            self.clear()
            self.size = 0
        self.size += fresh
        old = self.old
        return [k for k in keys if k not in self and k not in old]


def words_of(chunk: str) -> list[str]:
    """The words of PATTERN in a chunk, which may start with its one space."""
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isalpha():
        return [chunk]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return _find(chunk)


def split_all(wanted: Iterable[str]) -> dict[str, tuple[str, ...] | list[str]]:
    """words_of for chunks that stand after a space (given without it)."""
    parts = {}
    for c in wanted:
        if c.isalpha():
            parts[c] = (" " + c,)
        elif c[-1:] in _MARKS and c[:-1].isalpha():
            parts[c] = (" " + c[:-1], c[-1])
        else:
            parts[c] = _find(" " + c)
    return parts


def byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + n)] = b
    return names


class Automaton:
    """The merge automaton of a byte-level BPE vocabulary (a tokenizer's JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        names = byte_names()
        vocabulary = spec["model"]["vocab"]
        size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.labels[i] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.labels[i] = content.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # The gadgets: when a pair's arc goes, and for each label its own gadget's time and parts.
        self.removed: dict[int, int] = {}
        self.born, self.first, self.last = [-1] * size, [-1] * size, [-1] * size
        self.arcs: dict[int, bool] = {}
        alive = {i for token, i in vocabulary.items() if len(self.labels[i]) == 1}
        for time, merge in enumerate(spec["model"]["merges"]):
            u, v = (vocabulary[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            w = vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))]
            if w in alive or u not in alive or v not in alive or not self._arc(u, v, time):
                self.removed.setdefault(u << 20 | v, time)
                continue
            self.born[w], self.first[w], self.last[w] = time, u, v
            self.removed[u << 20 | v] = time
            alive.add(w)
        self.endings: dict = {}  # the labels, read backwards, as a tree
        for i in alive:
            node = self.endings
            for b in reversed(self.labels[i]):
                node = node.setdefault(b, {})
            node[-1] = i
        self.words, self.chunks = Kept(KEPT), Kept(KEPT // 2)
        sizes = np.array([len(x) for x in self.labels], np.int64)
        self.flat, self.sizes, self.starts = np.frombuffer(b"".join(self.labels), np.uint8), sizes, np.cumsum(sizes) - sizes

    def _arc(self, state: int, label: int, until: int) -> bool:
        """Whether the state has the arc once the gadgets before `until` are in place."""
        removed, born = self.removed, self.born
        while True:
            gone = removed.get(state << 20 | label)
            if gone is not None and gone < until:
                return False
            s, t = born[state], born[label]
            if s < 0 and t < 0:
                return True
            if t >= s:
                until, label = min(until, t + 1), self.first[label]
            else:
                until, state = min(until, s), self.last[state]

    def follows(self, state: int, label: int) -> bool:
        key = state << 20 | label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > 1_000_000:
                self.arcs.clear()
            found = self.arcs[key] = self._arc(state, label, 1 << 30)
        return found

    def run(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids, as little-endian 32-bit integers. Words are run in order, so that those with a common
        beginning share its states."""
        endings, follows, arcs, out = self.endings, self.follows, self.arcs, {}
        states, starts, before = [-1], [0], b""
        for word in sorted(words):
            data, same = word.encode("utf-8", "surrogatepass"), 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], starts[same + 1 :]
            for end in range(same, len(data)):
                node, at = endings, end
                while at >= 0:
                    node = node.get(data[at])
                    if node is None:
                        states.append(-1)
                        starts.append(-1)
                        break
                    token = node.get(-1)
                    if token is not None:
                        state = states[at]
                        if not at:
                            states.append(token)
                            starts.append(0)
                            break
                        if state >= 0:
                            ok = arcs.get(state << 20 | token)
                            if ok or ok is None and follows(state, token):
                                states.append(token)
                                starts.append(at)
                                break
                    at -= 1
                else:
                    states.append(-1)
                    starts.append(-1)
            ids, at = [], len(data)
            while at:
                ids.append(states[at])
                at = starts[at]
            out[word] = pack(f"<{len(ids)}I", *ids[::-1])
            before = data
        return out

    def learn(self, wanted: set[str]) -> None:
        """Makes sure that the ids of these chunks (each after a space) are kept."""
        parts = split_all(self.chunks.lack(wanted))
        words = self.words
        words.update(self.run(words.lack({w for ws in parts.values() for w in ws})))
        self.chunks.update((c, words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])) for c, ws in parts.items())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        runs: list[list] = []  # per text: chunk lists, and added tokens' ids between them
        for text in texts:
            if self.cut and self.cut.search(text):
                run: list = []
                at = 0
                for m in self.cut.finditer(text):
                    run += [chunks(text[at : m.start()]), self.added[m[0]]]
                    at = m.end()
                runs.append([*run, chunks(text[at:])])
            else:
                runs.append([chunks(text)])
        self.learn(set().union(*(part[1:] for run in runs for part in run if isinstance(part, list))))
        firsts = {part[0] for run in runs for part in run if isinstance(part, list)}
        heads = {c: words_of(c) if c else [] for c in firsts}
        known = self.run({w for ws in heads.values() for w in ws})
        get, out = self.chunks.__getitem__, []
        for run in runs:
            pieces = []
            for part in run:
                if isinstance(part, list):
                    pieces += [known[w] for w in heads[part[0]]]
                    pieces += map(get, part[1:])
                else:
                    pieces.append(pack("<I", part))
            out.append(b"".join(pieces))
        return out

    def decode_all(self, rows: list[bytes]) -> list[bytes]:
        """The labels of each row of ids, joined; bytes that are not UTF-8 are replaced as a decoder does."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.cumsum([len(x) // 4 for x in rows])
        cuts = [0, *np.concatenate([[0], ends])[stops].tolist()]
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0].decode()


def automaton(text: str) -> Automaton:
    """The automaton of a vocabulary, kept by the process until it needs another model."""
    return kept_model(text, lambda: Automaton(text))


def encoded(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256, of each whole text.

    `vocabulary` is the path of a tokenizer's JSON file on the driver; its text, whose size is fixed, is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        machine = automaton(shared.value)
        rows = machine.encode_all(texts)
        columns = [batch.column(0), pa.array([len(x) // 4 for x in rows], pa.int64())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            flat = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
            columns.append(pa.ListArray.from_arrays(np.cumsum([0] + [len(x) // 4 for x in rows]).astype(np.int32), flat))
            names.insert(2, "ids")
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in rows]))
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in machine.decode_all(rows)]))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), of, f"doc_id long, n_tokens long, {'ids array<int>, ' * ids}ids_sha256 string, decoded_sha256 string", model=True)


def decoded(tokens: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of id arrays (null: an empty text)."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            texts = [x.decode() for x in machine.decode_all([np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(of, "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_round_trip(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or default_vocabulary(), ids=False)
