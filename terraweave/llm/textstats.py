"""Per-document text quality statistics, and prose told from lists, tables and junk.

Method: long texts are split into chunks; each chunk gives associative partial
counts.  The lines that lie wholly in a chunk are judged at once; what stands
before the first and after the last line break stays open, as counts together
with the state at its borders: the first and the last runs of one kind of
signs, the token that goes on, the word that may be split.  Two neighbouring
pieces merge by joining the runs and the token at the cut and counting what the
join completes, so the counts are the same wherever a text is cut.  Merging is
a tree: chunks to parts where the text is read, parts to documents after that.
Ratios and rule outcomes come from the merged counts.

The counts are vectorised over the UTF-8 buffer of an Arrow batch; words are
compared with the list of frequent words in Arrow.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.tokenizer import code_points
from terraweave.session import durable

#: Bytes of a chunk, and chunks that are merged to a part where the text is read.
CHUNK = 1 << 16
FAN_IN = 64
#: Texts of fewer code points after trimming are no cases.
LEAST_LENGTH = 20

LETTER, DIGIT, BLANK, TAB, BREAK, STOP, COMMA, PIPE, COLON, QUIET, ODD = range(11)

# Signs of each class; every other sign is odd.
_SIGNS = {
    BLANK: "  ­            ​‎‏‪‫‬‭‮  　﻿",
    TAB: "\t",
    BREAK: "\n\r\x0b\x0c\x85  ",
    STOP: ".!?।॥…",
    COMMA: ",;",
    PIPE: "|",
    COLON: ":",
    QUIET: "'\"-()/–—‘’“”•*#′″&°²·",
}

#: Counts of a stretch of text; all add up but for the last four, which describe its ends.
COUNTS = ("chars", "letters", "digits", "blanks", "odd", "words", "common", "word_letters", "tokens", "long_chars", "short_tokens", "stops", "loose_commas", "tight_commas", "tabs", "pipes", "wide_gaps", "colons", "keys", "mixed")
ENDS = ("mark", "ends_stop", "head", "tail")
WIDTH = len(COUNTS) + len(ENDS)
_AT = {name: k for k, name in enumerate(COUNTS + ENDS)}

_LIST_SIGNS = "-*•–·"
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _TABLE:
        major = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000))))[::2].encode(), np.uint8)
        table = np.full(0x110000, ODD, np.uint8)
        table[(major == ord("L")) | (major == ord("M"))] = LETTER
        table[major == ord("N")] = DIGIT
        # The joiners stand inside words of Indic scripts.
        table[[0x200C, 0x200D]] = LETTER
        # Latin letters with signs stand in no text of these languages but in misread bytes.
        table[0x80:0x250] = np.where(table[0x80:0x250] == LETTER, ODD, table[0x80:0x250])
        for kind, signs in _SIGNS.items():
            table[[ord(c) for c in signs]] = kind
        _TABLE.append(table)
    return _TABLE[0]


#: Counts of single runs that depend on their neighbours, and counts of tokens.
CONTEXT = ("stops", "loose_commas", "tight_commas", "wide_gaps", "colons", "keys")
OF_TOKENS = ("tokens", "long_chars", "short_tokens", "mixed")
#: Counts that add up but for a word that a cut splits.
PLAIN = tuple(c for c in COUNTS if c not in CONTEXT + OF_TOKENS)


def run_counts(what: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray, ordinal: np.ndarray, previous: np.ndarray) -> dict[str, np.ndarray]:
    """CONTEXT of each run; ``before`` and ``after`` are the kinds of its neighbours (BREAK at the ends of
    a line), ``ordinal`` its place in the line and ``previous`` the length of the run before it."""
    blank = lambda k: (k == BLANK) | (k == TAB) | (k == BREAK)
    gap_before, gap_after = blank(before), blank(after)
    quiet_after = (after == QUIET) | (after == ODD)
    comma, colon = what == COMMA, what == COLON
    return {
        "stops": (what == STOP) & (gap_after | quiet_after) & (before != ODD) & ~((ordinal == 1) & (((before == LETTER) & (previous <= 1)) | (before == DIGIT))),
        "loose_commas": comma & gap_after & ~gap_before,
        "tight_commas": comma & ~gap_after,
        "wide_gaps": (what == BLANK) & (length >= 3) & (ordinal > 0) & (after != BREAK),
        "colons": colon & gap_after & (ordinal <= 3) & ((before == LETTER) | (before == DIGIT)),
        "keys": colon & (before == QUIET),
    }


def token_counts(size: np.ndarray, kinds: np.ndarray) -> dict[str, np.ndarray]:
    """OF_TOKENS of stretches without space: their signs and their runs of letters or digits."""
    return {"tokens": np.ones_like(size), "long_chars": np.where(size >= 30, size, 0), "short_tokens": (size <= 2).astype(np.int64), "mixed": np.where((kinds >= 4) & (size >= 12), size, 0)}


def _is_mark(kinds: list[int], lengths: list[int], signs: list[int]) -> bool:
    """Whether a line that begins with these runs begins with a list mark: a sign, a number or a letter with a sign, then a blank."""
    if len(kinds) > 1 and kinds[0] == QUIET and lengths[0] == 1 and chr(signs[0]) in _LIST_SIGNS and kinds[1] == BLANK:
        return True
    short = kinds[0] == DIGIT and lengths[0] <= 4 or kinds[0] == LETTER and lengths[0] <= 2
    return len(kinds) > 2 and short and lengths[1] == 1 and (kinds[1] == STOP and signs[1] == 0x2E or signs[1] == 0x29) and kinds[2] == BLANK


class _Runs:
    """The runs of one kind of signs in a UTF-8 buffer; a line break is a run of its own."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, common: pa.Array):
        cp, at = code_points(data)
        kind = _classes()[cp]
        self.first = np.searchsorted(at, begins)
        cut = np.zeros(len(cp), bool)
        cut[0] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
        cut[self.first] = True
        self.run = np.flatnonzero(cut)
        self.length = np.diff(np.append(self.run, len(cp)))
        self.what, self.sign = kind[self.run].astype(np.int64), cp[self.run]
        self.bounds = np.append(at[self.run], len(data)).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(self.run), pa.py_buffer(self.bounds), pa.py_buffer(np.ascontiguousarray(data)))
        self.common = pc.is_in(texts, value_set=common).to_numpy(zero_copy_only=False) & (self.what == LETTER)

    def plain(self) -> dict[str, np.ndarray]:
        """PLAIN of each run."""
        length, what = self.length, self.what
        space = (what == BLANK) | (what == TAB)
        word = what == LETTER
        of = lambda k: length * (what == k)
        return {
            "chars": length * (what != BREAK), "letters": of(LETTER), "digits": of(DIGIT), "blanks": length * space, "odd": of(ODD), "words": word.astype(np.int64), "common": self.common.astype(np.int64),
            "word_letters": np.where(word, length, 0), "tabs": of(TAB), "pipes": of(PIPE),
        }


def stretch_counts(data: np.ndarray, begins: np.ndarray, common: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every line of the texts in a UTF-8 buffer.

    ``begins``: byte positions where a text begins.  Returns (matrix of counts,
    index of the text of each line).  A line break ends a line and belongs to
    it without being counted.
    """
    r = _Runs(data, begins, common)
    what, length, run = r.what, r.length, r.run
    # Lines begin at a text's begin and after a break.
    opens = np.zeros(len(run), bool)
    opens[np.searchsorted(run, r.first)] = True
    opens[1:] |= what[:-1] == BREAK
    line_at = np.flatnonzero(opens)
    line = np.cumsum(opens) - 1
    lines = len(line_at)
    out = np.zeros((lines, WIDTH))

    def add(counts: dict[str, np.ndarray]) -> None:
        for name, weights in counts.items():
            out[:, _AT[name]] = np.add.reduceat(weights.astype(np.int64), line_at)

    add(r.plain())
    before, after = np.append(BREAK, what[:-1]), np.append(what[1:], BREAK)
    before[opens] = BREAK
    after[:-1][opens[1:]] = BREAK
    space, solid = (what == BLANK) | (what == TAB), what != BREAK
    tight = ~space & solid
    begins_token = tight & ((before == BLANK) | (before == TAB) | (before == BREAK))
    token_at = np.flatnonzero(begins_token)
    if len(token_at):
        size = np.add.reduceat(length * tight, token_at)
        kinds = np.add.reduceat((tight & ((what == LETTER) | (what == DIGIT))).astype(np.int64), token_at)
        for name, values in token_counts(size, kinds).items():
            spread = np.zeros(len(run), np.int64)
            spread[token_at] = values
            add({name: spread})
    add(run_counts(what, length, before, after, np.arange(len(run)) - line_at[line], np.append(0, length[:-1])))
    # How a line begins.
    k, last = line_at, len(run) - 1
    one, two = np.minimum(k + 1, last), np.minimum(k + 2, last)
    same1, same2 = line[one] == np.arange(lines), line[two] == np.arange(lines)
    sign = (what[k] == QUIET) & (length[k] == 1) & np.isin(r.sign[k], [ord(c) for c in _LIST_SIGNS]) & same1 & (what[one] == BLANK) & (one != k)
    numbered = ((what[k] == DIGIT) & (length[k] <= 4) | (what[k] == LETTER) & (length[k] <= 2)) & same1 & (one != k) & (((what[one] == STOP) & (r.sign[one] == 0x2E)) | (r.sign[one] == 0x29)) & (length[one] == 1) & same2 & (what[two] == BLANK) & (two != one)
    out[:, _AT["mark"]] = sign | numbered
    # How a line ends: the last run that is no space, quote or tag.
    plain = (solid & ~space & (what != QUIET)).astype(np.int64) * np.arange(1, len(run) + 1)
    final = np.maximum.reduceat(plain, line_at) - 1
    out[:, _AT["ends_stop"]] = (final >= 0) & ((what[final] == STOP) | (what[final] == COLON))
    ends = np.append(line_at[1:], len(run)) - 1
    out[:, _AT["head"]], out[:, _AT["tail"]] = what[line_at], what[ends]
    return out, np.searchsorted(r.first, run[line_at], "right") - 1


FORMS = ("prose", "list", "table", "junk")


def judged(m: np.ndarray) -> np.ndarray:
    """The form of each line (a row of counts): position in FORMS, -1 for an empty or ruled line."""
    c = {name: m[:, k] for name, k in _AT.items()}
    tokens, words = np.maximum(c["tokens"], 1), np.maximum(c["words"], 1)
    tight = np.maximum(c["chars"] - c["blanks"], 1)
    share = c["common"] / words
    plain = c["letters"] / tight
    commas = c["loose_commas"] + c["tight_commas"]
    odd = c["odd"] / tight > np.where(c["keys"] >= 2, 0.25, 0.12)
    blob = c["long_chars"] / tight > 0.5
    hexes = (c["short_tokens"] / tokens > 0.8) & (tokens >= 6) & (c["digits"] > 0)
    fields = np.maximum.reduce([c["tabs"], c["pipes"], c["wide_gaps"], c["tight_commas"]])
    rows = (c["tabs"] >= 1) | (c["pipes"] >= 2) | (c["wide_gaps"] >= 2) | ((c["tight_commas"] >= 2) & (c["loose_commas"] == 0)) | (c["keys"] >= 2)
    rows &= fields + c["keys"] >= tokens / 12
    record = (c["colons"] >= 1) & (tokens <= 6) & (c["stops"] == 0)
    sentence = (c["stops"] >= 1) | c["ends_stop"].astype(bool)
    spoken = (share >= 0.12) & (plain > 0.6) & (c["words"] >= 3)
    item = c["mark"].astype(bool) & ~(sentence & (words >= 5)) & (tokens <= 9)
    bare = (tokens <= 4) & (c["chars"] <= 32) & ~sentence
    series = (commas >= 2) & (c["loose_commas"] >= c["tight_commas"]) & (tokens / (commas + 1) <= 4.5) & (c["stops"] <= commas / 8)
    chant = (c["words"] >= 6) & (share < 0.04) & ~sentence & (commas == 0) & (c["mark"] == 0)
    babble = (c["words"] >= 8) & (share < 0.04) & (c["tight_commas"] >= c["loose_commas"]) & (commas > 0) & (c["digits"] / tight < 0.05)
    out = np.zeros(len(m), np.int64)
    out[chant] = 3
    out[series | item | bare] = 1
    out[record] = 2
    out[rows] = 2
    out[babble & ~series] = 3
    out[spoken & ~item & ~bare & ~record & ~series & ~(c["keys"] >= 2) & (fields <= tokens / 6)] = 0
    out[(blob & ~rows) | hexes | odd] = 3
    out[(c["tokens"] == 0) | (c["letters"] + c["digits"] + c["odd"] + c["stops"] == 0)] = -1
    return out


#: Totals of a document: sums of counts, judged characters by form and line statistics.
TOTALS = (*COUNTS, *[f"{f}_chars" for f in FORMS], "lines", "stop_lines", "mark_lines")


def totals_of(m: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Totals of the complete lines of each of ``n`` texts."""
    out = np.zeros((n, len(TOTALS)))
    form = judged(m)
    weight = m[:, _AT["chars"]] - m[:, _AT["blanks"]]
    for k in range(len(COUNTS)):
        out[:, k] = np.bincount(owner, m[:, k], n)
    for k in range(len(FORMS)):
        out[:, len(COUNTS) + k] = np.bincount(owner, weight * (form == k), n)
    full = form >= 0
    out[:, -3] = np.bincount(owner, full, n)
    out[:, -2] = np.bincount(owner, full & (m[:, _AT["ends_stop"]] > 0), n)
    out[:, -1] = np.bincount(owner, full & (m[:, _AT["mark"]] > 0), n)
    return out


#: Runs kept at the begin of an open piece (all but the last of them still to be counted) and at its end (all but the first).
FRONT, BACK = 5, 3


def open_piece(data: np.ndarray, common: pa.Array, longest: int) -> dict | None:
    """The state of a stretch of one line that may go on at both ends; None for an empty one.

    n: runs; front and back: the first and last of them as [kind, length, sign]
    (all in front if there are FRONT + BACK at most); plain, context: counts of
    what is settled; whole: whether there is no space; head and tail: size and
    kinds of the tokens at the ends (only head if whole); inner: counts of the
    tokens between; final: the last kind that is no space or quote, or -1;
    first and last word: its text if the piece begins or ends with a word no
    longer than the longest frequent one, "" for a longer one.
    """
    if not len(data):
        return None
    r = _Runs(data, np.zeros(1, np.int64), common)
    what, length, n = r.what, r.length, len(r.run)
    rows = [[int(k), int(w), int(c)] for k, w, c in zip(what[:FRONT], length[:FRONT], r.sign[:FRONT])] if n > FRONT + BACK else [[int(k), int(w), int(c)] for k, w, c in zip(what, length, r.sign)]
    back = [[int(what[i]), int(length[i]), int(r.sign[i])] for i in range(n - BACK, n)] if n > FRONT + BACK else []
    context = dict.fromkeys(CONTEXT, 0)
    if n > FRONT + BACK:
        inner = slice(FRONT - 1, n - BACK + 1)
        i = np.arange(n)[inner]
        context = {c: int(v.sum()) for c, v in run_counts(what[inner], length[inner], what[i - 1], what[i + 1], i, length[i - 1]).items()}
    tight = ~((what == BLANK) | (what == TAB) | (what == BREAK))
    named = (tight & ((what == LETTER) | (what == DIGIT))).astype(np.int64)
    gaps = np.flatnonzero(~tight)
    of = lambda a, b: [int(length[a:b].sum()), int(named[a:b].sum())]
    inner_tokens = dict.fromkeys(OF_TOKENS, 0)
    if len(gaps):
        at = np.flatnonzero(tight & np.append(False, ~tight[:-1]))
        at = at[(at > gaps[0]) & (at < gaps[-1])]
        if len(at):
            size, kinds = np.add.reduceat(length * tight, at), np.add.reduceat(named, at)
            # The last stretch reaches to the end of the piece; what is behind the last gap is the tail.
            size[-1] -= of(gaps[-1] + 1, n)[0]
            kinds[-1] -= of(gaps[-1] + 1, n)[1]
            inner_tokens = {c: int(v.sum()) for c, v in token_counts(size, kinds).items()}
    plain_kinds = what[tight & (what != QUIET)]

    def word(i: int) -> str | None:
        if what[i] != LETTER:
            return None
        return bytes(data[r.bounds[i] : r.bounds[i + 1]]).decode() if length[i] <= longest else ""

    return {
        "n": n, "front": rows, "back": back, "plain": {c: int(v.sum()) for c, v in r.plain().items()}, "context": context,
        "whole": not len(gaps), "head": of(0, gaps[0]) if len(gaps) else of(0, n), "tail": of(gaps[-1] + 1, n) if len(gaps) else [0, 0], "inner": inner_tokens,
        "final": int(plain_kinds[-1]) if len(plain_kinds) else -1, "first_word": word(0), "last_word": word(n - 1),
    }


def _settle(context: dict, runs: list, i: int, ordinal: int) -> None:
    """Add the counts of run i, whose neighbours stand in ``runs`` (the end of the line where there are none)."""
    before, after = runs[i - 1] if i else [BREAK, 0, 0], runs[i + 1] if i + 1 < len(runs) else [BREAK, 0, 0]
    one = [np.array([v]) for v in (runs[i][0], runs[i][1], before[0], after[0], ordinal, before[1])]
    for name, value in run_counts(*one).items():
        context[name] += int(value[0])


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def _with_token(counts: dict, token: list[int]) -> dict:
    return _added(counts, {k: int(v[0]) for k, v in token_counts(np.array(token[:1]), np.array(token[1:])).items()}) if token[0] else counts


def joined(left: dict | None, right: dict | None, common: set[str], longest: int) -> dict | None:
    """One open piece of two neighbouring ones."""
    if left is None or right is None:
        return left or right
    short_left, short_right = not left["back"], not right["back"]
    ends, begins = left["front"] if short_left else left["back"], right["front"]
    same = ends[-1][0] == begins[0][0] and begins[0][0] != BREAK
    seam = [*ends[:-1], [ends[-1][0], ends[-1][1] + begins[0][1], ends[-1][2]], *begins[1:]] if same else [*ends, *begins]
    n = left["n"] + right["n"] - same
    context, plain = _added(left["context"], right["context"]), _added(left["plain"], right["plain"])
    split_word = same and begins[0][0] == LETTER
    words = [left["first_word"], right["last_word"]]
    if split_word:
        plain["words"] -= 1
        halves = left["last_word"], right["first_word"]
        text = "".join(halves) if all(halves) and sum(map(len, halves)) <= longest else ""
        plain["common"] += (text in common) - sum(w in common for w in halves)
        words = [text if left["n"] == 1 else words[0], text if right["n"] == 1 else words[1]]
    # What has both neighbours now and may no more be among the first or last runs is settled.
    small = short_left and short_right and n <= FRONT + BACK
    if not small:
        low = FRONT - 1 if short_left else 1
        high = len(seam) - BACK + 1 if short_right else len(seam) - 1
        for i in range(low, high):
            _settle(context, seam, i, i if short_left else FRONT)
    front = seam if small else seam[:FRONT] if short_left else left["front"]
    back = [] if small else seam[-BACK:] if short_right else right["back"]
    # The token at the cut.
    doubled = same and begins[0][0] in (LETTER, DIGIT)
    a, b = left["head"] if left["whole"] else left["tail"], right["head"]
    token = [a[0] + b[0], a[1] + b[1] - doubled]
    inner = _added(left["inner"], right["inner"])
    whole = left["whole"] and right["whole"]
    head, tail = (token if left["whole"] else left["head"]), ([0, 0] if whole else token if right["whole"] else right["tail"])
    if not left["whole"] and not right["whole"]:
        inner = _with_token(inner, token)
    return {
        "n": n, "front": front, "back": back, "plain": plain, "context": context, "whole": whole, "head": head, "tail": tail, "inner": inner,
        "final": right["final"] if right["final"] >= 0 else left["final"], "first_word": words[0], "last_word": words[1],
    }


def line_counts(piece: dict | None) -> np.ndarray:
    """The counts of a piece that is a whole line."""
    out = np.zeros(WIDTH)
    if piece is None:
        return out
    context, front, back = dict(piece["context"]), piece["front"], piece["back"]
    for i in range(FRONT - 1 if back else len(front)):
        _settle(context, front, i, i)
    for i in range(1, len(back)):
        _settle(context, back, i, FRONT)
    tokens = _with_token(_with_token(piece["inner"], piece["head"]), piece["tail"])
    for name, value in (piece["plain"] | context | tokens).items():
        out[_AT[name]] = value
    out[_AT["mark"]] = _is_mark(*map(list, zip(*front)))
    out[_AT["ends_stop"]] = piece["final"] in (STOP, COLON)
    out[_AT["head"]], out[_AT["tail"]] = front[0][0], (back or front)[-1][0]
    return out


def _judged_line(piece: dict | None) -> np.ndarray:
    return totals_of(line_counts(piece)[None], np.zeros(1, np.int64), 1)[0]


def chunk_state(data: np.ndarray, common: pa.Array, longest: int) -> tuple:
    """(closed, head, tail, totals) of a chunk: what is open before its first and after its last line break,
    and the totals of the lines between; without a break only a head."""
    cp, at = code_points(data)
    breaks = np.flatnonzero(_classes()[cp] == BREAK)
    if not len(breaks):
        return False, open_piece(data, common, longest), None, np.zeros(len(TOTALS))
    edge = np.append(at, len(data))
    first, last = edge[breaks[0] + 1], edge[breaks[-1] + 1]
    totals = np.zeros(len(TOTALS))
    if last > first:
        m, _ = stretch_counts(data[first:last], np.zeros(1, np.int64), common)
        totals = totals_of(m, np.zeros(len(m), np.int64), 1)[0]
    return True, open_piece(data[:first], common, longest), open_piece(data[last:], common, longest), totals


def merged(states: list[tuple], common: set[str], longest: int) -> tuple:
    """One state of neighbouring chunks."""
    closed, head, tail, totals = states[0]
    totals = totals.copy()
    for next_closed, next_head, next_tail, next_totals in states[1:]:
        totals += next_totals
        if not closed:
            head, closed, tail = joined(head, next_head, common, longest), next_closed, next_tail
        elif next_closed:
            totals += _judged_line(joined(tail, next_head, common, longest))
            tail = next_tail
        else:
            tail = joined(tail, next_head, common, longest)
    return closed, head, tail, totals


def whole_totals(state: tuple) -> np.ndarray:
    """The totals of a document from its only state."""
    closed, head, tail, totals = state
    return totals + _judged_line(head) + (_judged_line(tail) if closed else 0)


# Literal markup that is no text, and the boxes of a check list.
_MARKUP = r"</?[A-Za-z][^<>\n]{0,40}>|<\|[a-z_]+\|>|```+|\*\*|={3,}"
_BOX = r"(?m)^([ \t]*)\[[ xX]?\] "


def _cleaned(texts: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(texts, _MARKUP, " ")
    return pc.utf8_lower(pc.replace_substring_regex(plain, _BOX, r"\1- "))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buffers = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(buffers[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of a column of about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    edges = np.append(0, np.flatnonzero(np.diff(part)) + 1)
    for a, b in zip(edges, np.append(edges[1:], len(texts))):
        if b > a:
            yield int(a), texts.slice(a, b - a)


def _cuts(data: np.ndarray, chunk: int) -> list[int]:
    """Edges of chunks of about ``chunk`` bytes, none within a code point."""
    edges = [0]
    while edges[-1] + chunk < len(data):
        edge = edges[-1] + chunk
        while edge < len(data) and data[edge] & 0xC0 == 0x80:
            edge += 1
        edges.append(edge)
    return [*edges, len(data)] if edges[-1] < len(data) else edges


def _trimmed(texts: pa.Array) -> pa.Array:
    """Code points of each text without white space at its ends."""
    return pc.fill_null(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0)


def _document_parts(common: pa.Array, key: str, chunk: int, names: list[str]):
    """One row of totals for a text of one chunk, and one open state for each FAN_IN chunks of a longer one."""
    words, longest = set(common.to_pylist()), max(map(len, common.to_pylist()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(2)):
                texts = pc.fill_null(texts, "")
                data, offsets = _buffer(_cleaned(texts))
                size, n = np.diff(offsets), len(texts)
                short = (size > 0) & (size <= chunk)
                trimmed = _trimmed(texts).to_numpy(zero_copy_only=False)
                totals = np.zeros((n, len(TOTALS)))
                if short.any():
                    kept = np.repeat(short, size)
                    own = np.flatnonzero(short)
                    m, owner = stretch_counts(data[kept], np.append(0, np.cumsum(size[own]))[:-1], common)
                    totals[own] = totals_of(m, owner, len(own))
                rows = [(i, 0, 1, None, totals[i]) for i in np.flatnonzero(size <= chunk)]
                for i in np.flatnonzero(size > chunk):
                    body = data[offsets[i] : offsets[i + 1]]
                    edges = _cuts(body, chunk)
                    states = [chunk_state(body[a:b], common, longest) for a, b in zip(edges[:-1], edges[1:])]
                    groups = [merged(states[k : k + FAN_IN], words, longest) for k in range(0, len(states), FAN_IN)]
                    if len(groups) == 1:
                        rows.append((i, 0, 1, None, whole_totals(groups[0])))
                    else:
                        rows += [(i, k, len(groups), json.dumps(g[:3]), g[3]) for k, g in enumerate(groups)]
                take = np.array([r[0] for r in rows])
                m = np.array([r[4] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n).take(pa.array(take)), batch.column(1).slice(at, n).take(pa.array(take)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(trimmed[take].astype(np.int64)), pa.array([r[3] for r in rows], pa.string()), *[pa.array(m[:, k]) for k in range(len(TOTALS))]],
                    names=names,
                )

    return run


def _joined_parts(common: pa.Array, names: list[str]):
    """The totals of each document from the states of its parts, in their order."""
    words, longest = set(common.to_pylist()), max(map(len, common.to_pylist()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                states = [(*json.loads(p["state"]), np.array(p["totals"])) for p in parts]
                out.append(whole_totals(merged(states, words, longest)))
            m = np.array(out).reshape(-1, len(TOTALS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(m[:, k]) for k in range(len(TOTALS))]], names=names)

    return run


def text_totals(documents: DataFrame, common_words: list[str], key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, trimmed, TOTALS...) of every document; all zero for a null or empty text.

    Every text is read once, whatever its length; ``trimmed`` counts its code
    points without white space at the ends.
    """
    common = pa.array(sorted({w.lower() for w in common_words if w}), pa.string())
    kind = dict(documents.dtypes)[key]
    totals = ", ".join(f"{t} double" for t in TOTALS)
    docs = documents.select(key, F.monotonically_increasing_id().alias("_row"), text)
    first = [key, "_row", "_part", "_parts", "trimmed", "_state", *TOTALS]
    parts = durable(docs.mapInArrow(_document_parts(common, key, chunk, first), f"{key} {kind}, _row bigint, _part bigint, _parts bigint, trimmed bigint, _state string, {totals}"))
    whole = parts.where("_parts = 1").select(key, "trimmed", *TOTALS)
    state = F.struct(F.col("_part").alias("part"), F.col("_state").alias("state"), F.array(*TOTALS).alias("totals"))
    gathered = parts.where("_parts > 1").groupBy("_row").agg(F.first(key).alias(key), F.first("trimmed").alias("trimmed"), F.array_sort(F.collect_list(state)).alias("parts"))
    joined_ = gathered.select(key, "trimmed", "parts").mapInArrow(_joined_parts(common, [key, "trimmed", *TOTALS]), f"{key} {kind}, trimmed bigint, {totals}")
    return whole.unionByName(joined_)


def _over(a: str, b: Column) -> Column:
    return F.when(b > 0, F.col(a) / b)


def quality_statistics(totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ratios of a document; null where the text has nothing to divide by."""
    tight = F.col("chars") - F.col("blanks")
    return totals.select(
        key,
        F.col("words").cast("bigint").alias("words"),
        _over("word_letters", F.col("words")).alias("mean_word_length"),
        _over("odd", tight).alias("symbol_ratio"),
        _over("digits", tight).alias("digit_ratio"),
        F.col("lines").cast("bigint").alias("lines"),
        _over("stop_lines", F.col("lines")).alias("punctuated_lines"),
        _over("mark_lines", F.col("lines")).alias("marked_lines"),
        _over("common", F.col("words")).alias("common_words"),
        *[_over(f"{f}_chars", tight).alias(f"{f}_share") for f in FORMS],
        F.col("chars").cast("bigint").alias("chars"),
    )


def found_forms(totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, form) of the documents whose characters mostly are not natural prose."""
    judged_chars = sum((F.col(f"{f}_chars") for f in FORMS[1:]), F.lit(0.0))
    best = F.greatest(*[F.col(f"{f}_chars") for f in FORMS[1:]])
    form = F.lit(None).cast("string")
    for f in FORMS[1:]:
        form = F.when(F.col(f"{f}_chars") == best, f).otherwise(form)
    return totals.where((F.col("trimmed") >= LEAST_LENGTH) & (judged_chars > F.col("prose_chars"))).select(key, form.alias("form"))
