"""Encoding of texts with a public byte-level BPE vocabulary.

Method: the merge list is compiled into a deterministic automaton by adding one
gadget a merge.  The states are tokens (the last one read), the arcs carry the
token they emit.  The gadget of a merge (u, v) -> w takes the arc v from state
u and brings in state w, which has the arcs of v as they are then and is
reached wherever u is reached then.  A sequence of tokens is a path exactly if
it is what the merges make of its text.

Nothing is copied for a new state: the arcs it lacks are what its parts lack at
its birth, so the automaton is kept in arrays with one entry a merge.  Tokens
are numbered in preorder of their left parts; what a gadget closes is then at
most two intervals of numbers, and an arc is looked up by bisection.  The row of
a state is put together when the state is first entered.

A word is encoded in one pass: every position is reached by exactly one path,
since every beginning of a word has exactly one encoding, so from each position
all arcs are followed once and nothing is ever taken back.  The labels of the
arcs are emitted from the end.  Decoding is their concatenation.

Pre-splitting is vectorised: a text is cut by the classes of neighbouring code
points (numpy over the UTF-8 buffer of an Arrow batch), the words are
dictionary-encoded in Arrow, and the automaton only runs over words a worker
has not met before.  The vocabulary file is sent to the executors by the driver.
"""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: The folder of the vocabulary files where no other is given.
VOCABULARIES = os.environ.get("TERRAWEAVE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"

#: Bytes of text that are split at once, and words a worker remembers.
CHUNK_BYTES = 4 << 20
MOST_WORDS = 1 << 21

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The code points with the Unicode property White_Space.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FOREVER = 1 << 60


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class TokenAutomaton:
    """The automaton of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = byte_names()
        vocabulary = {token: i for token, i in model["vocab"].items() if all(c in names for c in token)}
        self.label = {i: bytes(names[c] for c in token) for token, i in vocabulary.items()}
        size = max(self.label, default=-1) + 1
        self.parts: tuple[list[int], list[int]] = ([-1] * size, [-1] * size)
        self.birth = [-1] * size
        self.closing: dict[tuple[int, int], int] = {}
        self.closed: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        self.grown: list[list[int]] = [[] for _ in range(size)]
        roots = [i for i, text in self.label.items() if len(text) == 1]
        self.states = set(roots)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._add_gadget(rank, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self._number(roots)
        self.rows: dict[int, tuple[list[int], list[int]]] = {}
        self.spans: dict[int, tuple[list[int], np.ndarray]] = {}
        # The labels as a tree of bytes: node * 256 + byte leads to a node; a node may end a label.
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i in self.states:
            node = 0
            for byte in self.label[i]:
                step = node * 256 + byte
                node = self.next.get(step, -1)
                if node < 0:
                    node = self.next[step] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i

    def _add_gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Close arc v of state u and bring in state w; a merge whose arc is closed already never happens."""
        if u not in self.states or v not in self.states or self._is_closed(u, v, rank):
            return
        self.closing[u, v] = rank
        self.closed[u].append((rank, v))
        if w not in self.states:
            self.states.add(w)
            self.parts[0][w], self.parts[1][w], self.birth[w] = u, v, rank
            self.grown[u].append(w)

    def _border(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """What stands at one border of a token while it is built: (part, death), newest first."""
        death = _FOREVER
        while token >= 0:
            yield token, death
            death, token = self.birth[token], self.parts[side][token]

    def _is_closed(self, x: int, y: int, before: int) -> bool:
        """Whether state x has lost its arc y by some gadget before a rank."""
        right = list(self._border(y, 0))
        for a, a_dies in self._border(x, 1):
            for b, b_dies in right:
                rank = self.closing.get((a, b), before)
                # Of equal ranks the leftmost merge goes first.
                if rank < before and rank < a_dies and rank <= b_dies:
                    return True
        return False

    def _number(self, roots: list[int]) -> None:
        """Preorder numbers by left parts, and where the numbers of each token's descendants end."""
        self.at, self.until = [-1] * len(self.birth), [-1] * len(self.birth)
        count, stack = 0, [(r, False) for r in reversed(roots)]
        while stack:
            token, left_behind = stack.pop()
            if left_behind:
                self.until[token] = count
                continue
            self.at[token] = count
            count += 1
            stack.append((token, True))
            stack.extend((w, False) for w in reversed(self.grown[token]))

    def _closed_spans(self, token: int) -> tuple[list[int], np.ndarray]:
        """Ranks and number intervals of what a token's own gadgets close, in the order of the ranks."""
        known = self.spans.get(token)
        if known is None:
            ranks, spans = [], []
            for rank, v in self.closed[token]:
                # Closed are v and what grows from it on the right of the border no sooner than this merge.
                later = bisect_left(self.grown[v], rank, key=self.birth.__getitem__)
                first = self.at[self.grown[v][later]] if later < len(self.grown[v]) else self.until[v]
                ranks.append(rank)
                spans.append((self.at[v], self.at[v] + 1, first, self.until[v]))
            known = self.spans[token] = ranks, np.array(spans, np.int64).reshape(-1, 4)
        return known

    def row(self, state: int) -> tuple[list[int], list[int]]:
        """The closed arcs of a state: begins of the intervals, and the furthest end so far."""
        known = self.rows.get(state)
        if known is None:
            own = [self._closed_spans(part) for part, _ in self._border(state, 1)]
            cut = [spans[: bisect_left(ranks, dies)] for (ranks, spans), (_, dies) in zip(own, self._border(state, 1))]
            pairs = np.concatenate(cut).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            known = self.rows[state] = pairs[:, 0].tolist(), np.maximum.accumulate(pairs[:, 1]).tolist()
        return known

    def arc(self, left: int, right: int) -> bool:
        """Whether state ``left`` has the arc ``right``."""
        begins, ends = self.row(left)
        number = self.at[right]
        k = bisect_right(begins, number) - 1
        return k < 0 or ends[k] <= number

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        step, label_ends, at = self.next, self.ends, self.at
        reached = [-1] * (len(word) + 1)
        for i in range(len(word)):
            begins, ends = self.row(reached[i]) if i else ((), ())
            node = 0
            for j in range(i, len(word)):
                node = step.get(node * 256 + word[j], -1)
                if node < 0:
                    break
                token = label_ends[node]
                if token >= 0 and reached[j + 1] < 0:
                    k = bisect_right(begins, at[token]) - 1
                    if k < 0 or ends[k] <= at[token]:
                        reached[j + 1] = token
        path, i = [], len(word)
        while i:
            path.append(reached[i])
            i -= len(self.label[reached[i]])
        return path[::-1]

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 are replaced."""
        return b"".join(self.label[int(i)] for i in ids).decode("utf-8", "replace")


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        first = "".join(map(unicodedata.category, map(chr, range(0x110000))))[::2].encode()
        first = np.frombuffer(first, np.uint8)
        table = np.full(0x110000, _OTHER, np.uint8)
        table[first == ord("L")], table[first == ord("N")] = _LETTER, _NUMBER
        table[_WHITE_SPACE] = _SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte positions of their first bytes) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    if len(at) == len(data):
        return lead, at
    width = np.diff(np.append(at, len(data)))
    cp = np.where(width == 1, lead, lead & (0xFF >> (width + 1)))
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        cp[more] = (cp[more] << 6) | (data[at[more] + k] & 0x3F)
    return cp, at


def word_starts(cp: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Where the words of the pre-splitting pattern begin.

    ``new`` marks the first code point of each text.  A word is a run of
    letters, of numbers or of other signs, with one blank before it if there
    is one; white space but for that blank is a word, of which a last sign
    before other text stands alone; the English contractions 's 't 're 've 'm
    'll 'd are words where a word may begin.
    """
    if not len(cp):
        return np.zeros(0, bool)
    kind = _classes()[cp]
    start = new.copy()
    start[1:] |= kind[1:] != kind[:-1]
    leaves = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~new[1:]) + 1
    start[leaves] = cp[leaves - 1] != 0x20
    start[leaves - 1] = True
    quotes = np.flatnonzero((cp == 0x27) & start)
    if len(quotes):
        last = len(cp) - 1
        quotes = quotes[quotes < last]
        quotes = quotes[~new[quotes + 1]]
        a = cp[quotes + 1]
        one = quotes[np.isin(a, [ord(c) for c in "stmd"])]
        wide = quotes < last - 1
        b = np.where(wide & ~new[np.minimum(quotes + 2, last)], cp[np.minimum(quotes + 2, last)], 0)
        two = quotes[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        start[one + 1] = False
        start[two + 1] = False
        start[one[one + 2 <= last] + 2] = True
        start[two[two + 3 <= last] + 3] = True
    return start


class _Worker:
    """What one Python worker keeps between batches: the automaton and the words it has met."""

    def __init__(self, path: str):
        self.automaton = TokenAutomaton(path)
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, word: str) -> int:
        ids = self.automaton.encode_word(word.encode())
        k = len(self.known)
        if k == len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * k), np.resize(self.size, 2 * k)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[word] = k
        return k

    def encode(self, data: np.ndarray, offsets: np.ndarray, keep_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        data = np.ascontiguousarray(data[offsets[0] : offsets[-1]])
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        cp, at = code_points(data)
        new = np.zeros(len(cp), bool)
        begins = offsets[:-1][np.diff(offsets) > 0]
        new[np.searchsorted(at, begins)] = True
        starts = at[word_starts(cp, new)]
        bounds = np.append(starts, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > MOST_WORDS:
            self.known, self.used = {}, 0
        known = self.known
        code = np.fromiter((known[w] if w in known else self._learn(w) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy()]
        sizes = self.size[code]
        ends = np.cumsum(sizes)
        cut = np.searchsorted(starts, offsets)
        reach = np.append(0, ends)
        counts = np.diff(reach[cut])
        if not keep_ids:
            return np.zeros(0, np.int32), counts
        take = np.repeat(self.begin[code] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[take], counts


_WORKERS: dict[str, _Worker] = {}


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of about CHUNK_BYTES: (first text, offsets).

    A longer text is cut before a blank that follows other text, where a word
    begins in any case; its parts come with the same first text.
    """
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, "right")) - 1)
        if stop > k + 1 or offsets[stop] - offsets[k] <= CHUNK_BYTES:
            yield k, offsets[k : stop + 1]
        else:
            left, end = offsets[k], offsets[k + 1]
            while left < end:
                right = min(end, left + CHUNK_BYTES)
                if right < end:
                    window = data[left:end]
                    blanks = np.flatnonzero((window[CHUNK_BYTES // 2 : -1] != 0x20) & (window[CHUNK_BYTES // 2 + 1 :] == 0x20) & (window[CHUNK_BYTES // 2 : -1] > 0x20) & (window[CHUNK_BYTES // 2 : -1] < 0x7F))
                    right = left + CHUNK_BYTES // 2 + 1 + int(blanks[0]) if len(blanks) else end
                yield k, np.array([left, right])
                left = right
        k = stop


def encode_batch(texts: pa.StringArray, path: str, keep_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text); null counts as empty."""
    worker = _WORKERS.get(path) or _WORKERS.setdefault(path, _Worker(path))
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(texts) else np.zeros(0, np.uint8)
    counts, flat = np.zeros(len(texts), np.int64), []
    for first, bounds in _pieces(data, offsets):
        ids, n = worker.encode(data, bounds, keep_ids)
        counts[first : first + len(n)] += n
        flat.append(ids)
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), counts


def _as_one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_SENT: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file to the executors, once per application, if the driver has it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _SENT.add(key)


def _received(path: str) -> str:
    """Where a worker finds a vocabulary file: what was sent, else the same folder as on the driver."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def token_ids(documents: DataFrame, vocabulary: str = BYTE_BPE_50K, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every document, without special tokens.

    A null or empty text gives an empty list.  Every row of the input has one
    row, repeated keys included; other columns are not read.
    """
    path = os.path.join(folder, vocabulary)
    send(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encode_batch(_as_one(batch.column(1)), _received(path))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = BYTE_BPE_50K, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES) -> DataFrame:
    """(key, tokens) of every document; 0 for a null or empty text."""
    path = os.path.join(folder, vocabulary)
    send(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = encode_batch(_as_one(batch.column(1)), _received(path), keep_ids=False)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=[key, "tokens"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, tokens bigint")
